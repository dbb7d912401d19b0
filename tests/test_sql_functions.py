"""SQL names give what the column functions give, on whole noisy texts."""

from pyspark.sql import functions as F

from corpusloom.functions import sql, text


def test_sql_functions_equal_column_functions(spark, views):
    names = sql.register(spark)
    columns = {"clean_html_text": text.clean_html_text, "collapse_ws": text.collapse_ws, "printable": text.printable,
               "tidy_line": text.tidy_line, "xml_safe": text.xml_safe, "one_line": text.one_line, "bcp47": text.bcp47, "field_slug": text.slug}
    assert set(names) == set(columns)
    wide = views.noisy.withColumn("text", F.concat(F.lit(" \t\n\n\n\n "), F.replace("text", F.lit(", "), F.lit(" <&\"> \t ,"))))
    for name, fn in columns.items():
        same = wide.select(fn("text").alias("a"), F.expr(f"{name}(text)").alias("b"))
        assert same.where(~F.col("a").eqNullSafe(F.col("b"))).isEmpty(), name
