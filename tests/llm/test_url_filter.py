"""Rules, splits and scores against plain forms of each."""

import itertools
import math
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import queries
from corpusloom.llm import url_filter as uf

from ..conftest import SMALL

RULES = [*queries.RULES, uf.Rule("b.a.example.com", "", "block"), uf.Rule("x", "/y", "block")]
URLS = [
    None, "", "no scheme", "http://", "://", "http://com", "http://com/", "http://COM/x", "https://a.example.com/en/1?x=/fr/", "http://example.com/en", "http://xexample.com/en/",
    "HTTP://WWW.Example.Com/en/É?q#f", "http://deep.www.example.com/en/a", "https://a.net/es/", "https://a.net/fr/x#/es/", "https://a.net/de/", "net/es/", "x://y://z/a", "http://h?/p", "http://h#/p",
    "http://h/p#q?r", "http://user@a.net:80/es/", "http://b.a.example.com?x", "http://é.net/es/", "http://x/y", "http://x/yz", "http://.com/", "http://com./", "file:///net/es/", "a\nb://c.net/es/\nd",
]
SCHEMA = "page_id long, url string, host string, path string, words string, found int"


def parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return ("", "") if not m else (re.sub("[A-Z]", lambda c: c.group().lower(), m[1]), m[2])


def ruled(host, path):
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: (len(r.name), len(r.host)), default=None)


def pages(spark, urls):
    rows = spark.createDataFrame([(i, u, "clash", "clash", "clash", 1) for i, u in enumerate(urls)], SCHEMA)
    return rows.select("page_id", uf.host_of(F.col("url")).alias("host"), uf.path_of(F.col("url")).alias("path"))


def model(spark, urls, **how):
    return uf.train(pages(spark, urls), uf.public_words(public_tokenizers.path(queries.WORDS), 1e5), how=uf.Words(**how))


def test_parts_and_rules(spark):
    urls = [*URLS, "http://" + "a." * 300_000 + "net/es/", "http://" + "a" * 300_000 + ".net/es/" + "b/" * 300_000, *URLS[-4:]]
    got = uf.judge(pages(spark, urls), uf.Filter({}, prior=-1.0), RULES).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = parts(urls[r.page_id])
        want = ruled(host, path)
        assert (r.host, r.path) == (host, path)
        assert (r.rule, r.verdict) == ((want.name, want.verdict) if want else (None, "allow"))
    assert {r.rule for r in uf.judge(pages(spark, URLS), uf.Filter({}), []).collect()} == {None}


@pytest.mark.parametrize("seed", range(30))
def test_split_is_the_likeliest(seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 4))): rng.randint(1, 500) for _ in range(8)}
    splitter = uf.Splitter(words, 5)
    total = sum(words.values())
    for _ in range(20):
        name = "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))

        def cost(split):
            return sum(-math.log(words[w] / total) if w in words else -math.log(10 / total / 10 ** len(w)) for w in split)

        every = []
        for cuts in itertools.product([0, 1], repeat=max(0, len(name) - 1)):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(name)]
            every.append([name[a:b] for a, b in itertools.pairwise(at) if a < b])
        least = min(cost(s) for s in every if all(len(w) <= 5 for w in s))
        got = splitter.split(name)
        assert "".join(got) == name and cost(got) == pytest.approx(least)


def test_run_together_names(spark):
    known = [f"http://{a}-{b}.example.org/en/{n}" for n, (a, b) in enumerate(itertools.product(("casino", "city", "green", "poker"), ("win", "park", "farm", "house")))]
    known += [f"http://www.site{n}.example.org/en/{n}" for n in range(40)] + [f"http://{w}-win.example.net/" for w in ("bet", "jackpot", "slots")]
    learned = model(spark, known)
    asked = ["http://cheappillsonline.example.org/en/9", "http://freebets.example.org/en/1", "http://citypark.example.org/en/1", "http://www.universitylibrary.example.org/en/", "http://bigwin.example.org/en/4", "http://a.example.org/poker/win"]
    got = {r.page_id: r for r in uf.judge(pages(spark, asked), learned, ()).collect()}
    assert got[0].words.split()[:3] == ["cheap", "pills", "online"] and got[1].words.split()[:2] == ["free", "bets"] and got[2].words.split()[:2] == ["city", "park"]
    assert [got[i].verdict for i in range(6)] == ["block", "block", "allow", "allow", "allow", "block"]
    assert learned.odds["win"] > 1 > abs(learned.odds["example"])


def test_counts_against_plain_ones(spark):
    urls = [r.url for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("url").collect()] * 2 + URLS
    learned = model(spark, urls)
    apart = {(h, w) for h, p in map(parts, urls) for label in [*[x for x in h.split(".") if re.search("[-_]", x)], p] for w in re.findall(r"[^\W\d_]+", label.lower()) if 1 < len(w) <= 24}
    plain = uf.public_words(public_tokenizers.path(queries.WORDS), 1e5)
    for _, w in apart:
        plain[w] = plain.get(w, 0) + 1
    assert learned.counts == plain
    split = learned.splitter()
    told, hosts = set(), set()
    for h, p in map(parts, urls):
        words = split.words(h) + split.words(p)
        bad = bool(set(words) & set(uf.LEXICON))
        told |= {(h, w, bad) for w in words}
        hosts |= {(h, bad)} if h or p else set()
    bad = sum(b for _, _, b in told) + len(uf.LEXICON)
    good = sum(not b for _, _, b in told)
    assert learned.prior == pytest.approx(math.log(sum(b for _, b in hosts) + 1) - math.log(sum(not b for _, b in hosts) + 1))
    for word in {w for _, w, _ in told} | set(uf.LEXICON):
        b, g = sum(x == word and y for _, x, y in told) + (word in uf.LEXICON), sum(x == word and not y for _, x, y in told)
        share = 20 * (b + g) / (bad + good)
        assert learned.odds[word] == pytest.approx(math.log((b + share) / (bad + 20)) - math.log((g + share) / (good + 20)))
    for r in uf.judge(pages(spark, urls), learned, ()).collect():
        odds = learned.prior + sum(learned.odds.get(w, 0) for w in r.words.split())
        assert r.score == pytest.approx(1 / (1 + math.exp(-odds)))
        assert r.verdict == ("block" if odds > 0 else "allow")


def test_small_table(spark):
    got = queries.op13_url_filter(spark, SMALL).toPandas()
    names = re.compile("casino|bets|pills|adult|spam|ads-")
    free = got[got.rule.isna()]
    assert len(free) and ((free.verdict == "block") == free.host.str.contains(names)).all()


def test_empty_table(spark):
    learned = model(spark, [])
    assert uf.judge(pages(spark, []), learned, RULES).count() == 0
    assert uf.judge(pages(spark, [None]), learned, RULES).collect()[0].verdict == "allow"
