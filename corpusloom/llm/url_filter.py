"""URL filters: listed rules first, then words and a multinomial naive Bayes.

Host and path are taken from the address by expressions. A rule (host, path,
verdict) fits its host and all subdomains of it, if the path starts with the
rule's; the longest wins. Rules are configuration: they become one map in the
plan, looked up for as many trailing labels of a host as any rule has.

Where no rule fits, names are split into words: letters of a label run together
are cut by a unigram Viterbi, whose words are those of a public vocabulary,
weighted by rank, and those that addresses in the table show apart themselves
(pieces of hyphenated labels and of paths), counted over all rows. Words of host
and path, and one mark per run of digits, are scored by naive Bayes. Its two
classes are learned from all rows: an address with a word of the lexicon counts
as blocked, others as allowed, so that words which keep such company, such as
the other halves of names, are learned, and words that all addresses share say
nothing. A host counts a word once, so a hot host weighs no more than another.
Shares are smoothed towards the word's share in both classes together; each word
of the lexicon is seen once in addition. Unknown words say nothing.

The driver holds at most ``Words.most`` words with their counts; totals are over
all words. Counting is a grouping with map-side sums, so no host is a hot key.

A null address, or one without ``://``, has an empty host and path, no rule, and
the verdict of the prior. Long labels are split in linear time, a word being at
most ``Words.longest`` letters long. Repeated rows are judged alike. An empty
table gives an empty result. Only the columns named are read.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import per_slice
from .vocabulary import MOST_BYTES

# Words that name what is blocked.
LEXICON = (
    "adult", "ads", "adserver", "bet", "bets", "betting", "casino", "cialis", "crack", "escort", "gambling", "jackpot", "keygen",
    "lottery", "malware", "nude", "payday", "phishing", "pill", "pills", "poker", "porn", "replica", "sex", "slots", "spam",
    "tracker", "tracking", "viagra", "warez", "xxx",
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = re.compile(r"[^\W\d_]+|\d+")
NUMBER = "0"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Words:
    most: int = 1 << 16
    longest: int = 24
    #: Weight of the public vocabulary: its first word counts as often as this, the n-th an n-th of it.
    weight: float = 1e5
    #: Strength of the smoothing, in words.
    smoothing: float = 20.0


def host_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.translate(F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    after = F.substring(rest, F.length(F.regexp_extract(rest, "^[^/?#]*", 0)) + 1, F.length(url))
    return F.coalesce(F.regexp_extract(after, "^[^?#]*", 0), F.lit(""))


def rule_of(host: Column, path: Column, rules: Iterable[Rule]) -> Column:
    """(length, host's length, name, verdict) of the longest rule that fits, else null; of equal ones that of the longer host."""
    by_host: dict[str, list[Rule]] = {}
    for r in rules:
        by_host.setdefault(r.host, []).append(r)
    if not by_host:
        return F.lit(None).cast("struct<length:int,host:int,name:string,verdict:string,path:string>")
    labels = max(h.count(".") + 1 for h in by_host)

    def one(r: Rule) -> Column:
        return F.struct(F.lit(len(r.name)).alias("length"), F.lit(len(r.host)).alias("host"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.path).alias("path"))

    known = F.create_map(*[x for h, rs in by_host.items() for x in (F.lit(h), F.array(*map(one, rs)))])
    last = F.split(F.substring_index(host, ".", -labels), r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(last)), lambda i: F.array_join(F.slice(last, -i, i), "."))
    found = F.flatten(F.filter(F.transform(ends, lambda e: F.try_element_at(known, e)), lambda x: x.isNotNull()))
    return F.array_max(F.filter(found, lambda r: F.startswith(path, r["path"])))


def public_words(path: str, weight: float) -> dict[str, float]:
    """Whole words of a public vocabulary (JSON, ``</w>`` at a word's end) with counts that fall with their rank."""
    with open(path, "rb") as f:
        raw = f.read(MOST_BYTES + 1)
    if len(raw) > MOST_BYTES:
        raise ValueError(f"{path} holds more than {MOST_BYTES} bytes: not a vocabulary")
    ids = json.loads(raw)["model"]["vocab"]
    words = sorted((i, t[:-4]) for t, i in ids.items() if t.endswith("</w>") and t[:-4].isalpha() and (len(t) > 5 or t[0] in "ai"))
    return {w: weight / n for n, (_, w) in enumerate(words, 1)}


class Splitter:
    """Cuts letters run together into the likeliest words."""

    def __init__(self, counts: dict[str, float], longest: int):
        total = sum(counts.values()) or 1.0
        self.cost = {w: math.log(total) - math.log(n) for w, n in counts.items() if n > 0}
        self.unknown, self.longest = math.log(total) - math.log(10), longest
        self.split = lru_cache(maxsize=1 << 14)(self._split)

    def _split(self, name: str) -> tuple[str, ...]:
        """A word not known costs ten times more with each letter. Of equal splits, that with the longer last word."""
        best, cut = [0.0], [0]
        for end in range(1, len(name) + 1):
            least, at = math.inf, end - 1
            for start in range(max(0, end - self.longest), end):
                c = best[start] + self.cost.get(name[start:end], self.unknown + math.log(10) * (end - start))
                if c < least:
                    least, at = c, start
            best.append(least)
            cut.append(at)
        words, end = [], len(name)
        while end:
            words.append(name[cut[end]: end])
            end = cut[end]
        return tuple(reversed(words))

    def words(self, text: str) -> list[str]:
        """Words of a host or path in order; a run of digits is NUMBER."""
        return [w for x in LETTERS.findall(text.lower()) for w in ((NUMBER,) if x[0].isdigit() else self.split(x))]


@dataclass
class Filter:
    """What has been learned: word counts, and the log-odds of a word and of the prior for being blocked."""

    counts: dict[str, float]
    odds: dict[str, float] = field(default_factory=dict)
    prior: float = 0.0
    longest: int = Words.longest

    def splitter(self) -> Splitter:
        return Splitter(self.counts, self.longest)

    def score(self, words: list[str]) -> float:
        """Probability of being blocked."""
        odds = self.prior + sum(self.odds.get(w, 0.0) for w in words)
        return 1 / (1 + math.exp(-odds)) if odds > -700 else 0.0


def _once(make: Callable) -> Callable:
    """The value of make(), built on first use in each worker's step."""
    made: list = []

    def get():
        if not made:
            made.append(make())
        return made[0]

    return get


def train(addresses: DataFrame, vocabulary: dict[str, float], lexicon: Iterable[str] = LEXICON, how: Words = Words()) -> Filter:
    """Learn from all rows of (host, path)."""
    listed = frozenset(lexicon)
    seen = addresses.where("host <> '' or path <> ''")
    shown = F.filter(F.split("host", r"\."), lambda x: x.rlike("[-_]"))
    pieces = F.flatten(F.transform(F.concat(shown, F.array("path")), lambda x: F.split(F.lower(x), r"[^\p{L}]+")))
    apart = seen.select("host", F.explode(F.array_distinct(pieces)).alias("word")).where((F.length("word") > 1) & (F.length("word") <= how.longest)).distinct()
    counts = dict(vocabulary)
    for word, n in apart.groupBy("word").count().orderBy(F.desc("count"), "word").limit(how.most).collect():
        counts[word] = counts.get(word, 0.0) + n
    model = Filter(counts, longest=how.longest)
    splitter = _once(model.splitter)

    def tell(batch: pa.RecordBatch) -> pa.RecordBatch:
        split, out = splitter(), {}
        for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
            words = split.words(host) + split.words(path)
            blocked = not listed.isdisjoint(words)
            out.update(dict.fromkeys((host, w, blocked) for w in [*words, ""]))  # the empty word counts hosts
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.bool_())], ["host", "word", "blocked"])

    told = seen.select("host", "path").mapInArrow(per_slice(tell, "path"), "host string, word string, blocked boolean").distinct()
    per_word = told.groupBy("word").agg(F.count_if("blocked").alias("bad"), F.count_if(~F.col("blocked")).alias("good"))
    bad, good = per_word.where("word <> ''").agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    rows = per_word.orderBy(F.desc(F.col("bad") + F.col("good")), "word").limit(how.most + 1).collect()
    found = {w: (b, g) for w, b, g in rows}
    hosts = found.pop("", (0, 0))
    for w in listed:
        b, g = found.get(w, (0, 0))
        found[w] = (b + 1, g)
    bad += len(listed)
    m = how.smoothing
    for w, (b, g) in found.items():
        share = m * (b + g) / (bad + good)
        model.odds[w] = math.log((b + share) / (bad + m)) - math.log((g + share) / (good + m))
    model.prior = math.log(hosts[0] + 1) - math.log(hosts[1] + 1) if sum(hosts) else -1.0
    return model


def judge(pages: DataFrame, model: Filter, rules: Iterable[Rule], threshold: float = 0.5) -> DataFrame:
    """(key, host, path, rule, verdict, score, words) of rows (key, host, path): the rule's verdict, else that of the words."""
    splitter = _once(model.splitter)
    key = next(c for c in pages.columns if c not in ("host", "path"))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        split = splitter()
        words = [split.words(h) + split.words(p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
        new = [pa.array([model.score(w) for w in words], pa.float64()), pa.array([" ".join(w) for w in words], pa.string())]
        return pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "score", "words"])

    ruled = pages.withColumn("found", rule_of(F.col("host"), F.col("path"), rules)).select(key, "host", "path", F.col("found.name").alias("rule"), F.col("found.verdict").alias("said"))
    kinds = ", ".join(f"`{n}` {k}" for n, k in ruled.dtypes)
    scored = ruled.mapInArrow(per_slice(score, "path"), f"{kinds}, score double, words string")
    verdict = F.coalesce("said", F.when(F.col("score") > threshold, "block").otherwise("allow"))
    return scored.select(key, "host", "path", "rule", verdict.alias("verdict"), "score", "words")
