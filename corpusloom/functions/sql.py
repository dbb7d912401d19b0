"""The text functions under SQL names, as SQL functions the optimizer inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text as t


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def _sub(arg: str, pattern: str, by: str) -> str:
    return f"regexp_replace({arg}, {_lit(pattern)}, {_lit(by)})"


def _trim(arg: str) -> str:
    return _sub(arg, f"^{t.WS}+|{t.WS}+$", "")


def _bodies() -> dict[str, tuple[str, str]]:
    """Name → (parameters, body)."""
    squashed = _sub("coalesce(s, '')", f"{t.WS}+", " ")
    spaced = _sub(_sub("s", f"{t.HORIZONTAL_WS}*\n{t.HORIZONTAL_WS}*", "\n"), f"{t.HORIZONTAL_WS}+", " ")
    escaped = _sub("s", t.XML_ILLEGAL, "")
    for raw, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot")):
        escaped = f"replace({escaped}, {_lit(raw)}, '&{name};')"
    return {
        "clean_html_text": ("s STRING", _sub("s", t.CONTROLS_AND_NBSP, " ")),
        "collapse_ws": ("s STRING", _trim(_sub(spaced, "\n{3,}", "\n\n"))),
        "printable": ("s STRING", _sub("s", t.CONTROLS, "")),
        "tidy_line": ("s STRING", _sub(_sub(r"translate(s, '\t', ' ')", t.LINE_ILLEGAL, ""), f"{t.WS}+$", "")),
        "xml_safe": ("s STRING", escaped),
        "one_line": ("s STRING", f"substring({_trim(squashed)}, 1, 200)"),
        "bcp47": ("s STRING", f"CASE WHEN {_trim('s')} RLIKE {_lit(t.LANGUAGE_TAG)} THEN {_trim('s')} ELSE 'und' END"),
        "field_slug": ("s STRING", "coalesce(nullif(" + _sub(_sub("lower(s)", "[^a-z0-9]+", "_"), "^_|_$", "") + ", ''), 'field')"),
    }


def register(spark: SparkSession) -> list[str]:
    """Create the functions in this session; returns their names."""
    for name, (params, body) in _bodies().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS STRING RETURN {body}")
    return list(_bodies())
