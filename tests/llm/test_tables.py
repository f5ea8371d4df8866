"""Operators on vectors, URLs and whole tables against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rehome.llm.mixing import fair_mix
from rehome.llm.queries import ORACLES, QUERIES, RULES
from rehome.llm.shards import document_dimensions, kd_shards
from rehome.llm.shared import components, running_sums
from rehome.llm.topk import top_products
from rehome.llm.url_model import judge_urls
from rehome.llm.vector_groups import near_vectors, spanning_rows


def vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 8)).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (base[0] * (1 + i)).tolist()) for i in range(30)]
    rows += [(200 + i, (base[1] + rng.normal(0, 0.03, 8)).tolist()) for i in range(40)]
    rows += [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [1.0, None] * 4), (304, [float("inf")] * 8), (305, []),
             (306, [1.0, 2.0]), (307, [2.0, 4.0]), (5, base[5].tolist()), (None, base[2].tolist()), (400, base[3].tolist())]
    return spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<double>, home string"), rows


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 120)] + [(500, 600 + i) for i in range(50)] + [(rng.randint(1000, 1200), rng.randint(1000, 1200)) for _ in range(90)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ends = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root[x] for x in ends}
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
    ids, roots = spanning_rows(np.array([5, 4, 9]), np.array([4, 3, 8]))
    assert dict(zip(ids.tolist(), roots.tolist())) == {5: 3, 4: 3, 3: 3, 9: 8, 8: 8}


def test_running_sums(spark):
    df = spark.range(100).selectExpr("id", "id % 7 AS n")
    got = {r.id: r.upto for r in running_sums(df, [F.col("id")], {"upto": "n"}, 6).collect()}
    assert got == {i: sum(k % 7 for k in range(i + 1)) for i in range(100)}


@pytest.mark.parametrize("settings", [{}, {"cell_rows": 4, "block_rows": 8}])
def test_near_vectors_are_brute_force(spark, settings):
    df, rows = vectors(spark)
    use = [(i, np.array(v, float)) for i, v in rows if i is not None and fine(v) and any(v)]
    near = lambda a, b: len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95 - 1e-12
    links = Counter()
    root = {i: i for i, _ in rows}
    pairs = [(x, y) for x in range(len(use)) for y in range(len(use)) if x != y and near(use[x][1], use[y][1])]
    by_row = Counter(x for x, _ in pairs)
    for _ in range(60):
        for x, y in pairs:
            a, b = use[x][0], use[y][0]
            root[a] = root[b] = min(root[a], root[b])
    for x, (i, _) in enumerate(use):
        links[i] = by_row[x]
    got = near_vectors(df, **settings).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, False)
        else:
            # A row without an id takes no part, so its copy does not count it.
            assert (r.n_links, r.component_id, r.kept) == (links[r.vec_id], root[r.vec_id], root[r.vec_id] == r.vec_id), r
    assert near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("settings", [{}, {"tile_rows": 3, "shard_rows": 5, "fan": 2}])
def test_top_products_are_brute_force(spark, settings):
    df, rows = vectors(spark)
    held = {(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if i is not None and fine(v)}
    want = []
    for i, v in held:
        if i % 10 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in held if j != i and len(w) == len(v))
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(found[:10])]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in top_products(df, F.col("vec_id") % 10 == 0, **settings).collect()]
    assert sorted(got) == sorted(want)
    assert top_products(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_products_beyond_doubles_are_exact(spark):
    df = spark.createDataFrame([(0, [1000001.5, 7.0]), (1, [999999.25, 1.0]), (2, [999999.25, 2.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in top_products(df, F.col("vec_id") == 0, scale=2**10).collect()}
    v = {i: [math.floor(1024 * x) for x in e] for i, e in [(0, [1000001.5, 7.0]), (1, [999999.25, 1.0]), (2, [999999.25, 2.0])]}
    assert got == {i: sum(a * b for a, b in zip(v[0], v[i])) for i in (1, 2)}


def test_products_beyond_longs_are_exact_or_the_largest_long(spark):
    rows = [(0, [1e17, 1.0]), (1, [1e17, 1.0]), (2, [1e-300, 3.0]), (3, [-1e300, 0.0]), (4, [1e300, 1.0]), (5, [1e17, 1.0]), (5, [1e17, 1.0]), (2**60 + 1, [2.0**52, -7.5])]
    found = top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    got = {r.vec_id: r.score for r in sorted(found, key=lambda r: r.rank)}
    whole = lambda v: [math.floor(1024 * Fraction(x)) for x in v]
    exact = {i: sum(a * b for a, b in zip(whole(rows[0][1]), whole(v))) for i, v in rows[1:]}
    assert got == {i: max(1 - 2**63, min(2**63 - 1, x)) for i, x in exact.items()} and abs(got[2]) < 2**62
    assert list(got)[:4] == [1, 4, 5, 2**60 + 1] and list(got)[-1] == 3


def test_url_parts_and_rules(spark):
    urls = {1: None, 2: "", 3: "no scheme/x", 4: "HTTP://A.Com/Path?q#f", 5: "http://a.com", 6: "http://a.com?x=/y", 7: "http://www.example.com/en/1", 8: "http://x.www.example.com/en/1",
            9: "http://m.example.com/en/1", 10: "http://notexample.com/en/1", 11: "http://a.net/es/1", 12: "http://a.net/fr/", 13: "http://a.net/en/", 14: "x://y://z/p", 15: "http://com/",
            16: "http://net/es/" + "é" * 3000, 17: "http://\n.org/\n"}
    rows = [*urls.items(), (4, urls[4]), (None, "http://b.org/de/1")]
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in rows], "page_id long, url string, host string, rule string")
    got = judge_urls(df, RULES).collect()
    assert len(got) == len(rows)
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict if r.rule else None) for r in got}
    assert by[1] == by[2] == by[3] == ("", "", None, None)
    assert by[4] == ("a.com", "/Path", "com/", "allow")
    assert by[5] == ("a.com", "", None, None) and by[6] == ("a.com", "", None, None)
    assert by[7][2:] == ("www.example.com/en/", "allow") == by[8][2:]
    assert by[9][2:] == ("example.com/en/", "block") and by[10][2:] == ("com/", "allow")
    assert by[11][2:] == ("net/es/", "block") and by[12][2:] == ("net/fr/", "block") and by[13][2:] == (None, None)
    assert by[14][:2] == ("y:", "//z/p") and by[15][2:] == ("com/", "allow") and by[17][:2] == ("\n.org", "/\n")
    assert {r.verdict for r in got} == {"allow", "block"} and None not in {r.ratio for r in got}
    assert judge_urls(df.limit(0), RULES).count() == 0
    assert {r.verdict for r in judge_urls(df.filter("page_id = 13"), RULES).collect()} == {"allow"}
    assert {r.verdict for r in judge_urls(df.filter("page_id in (11, 13)"), RULES).collect()} == {"block"}


def test_url_ratio_is_brute_force(spark):
    urls = ["http://a.com/x1", "http://b.com/x22", "http://a.net/es/9", "http://c.net/fr/91", "http://o.org/x1", "http://o.org/es/9", "http://a.com/x1",
            "http://q.org/z?to=a.com", "http://q.org/z?to=a.net/es/", "https://a.com/x1#top", "mailto:x@a.net", "foo", ""]
    judged = judge_urls(spark.createDataFrame([*enumerate(urls), (len(urls), None)], "page_id long, url string"), RULES).collect()
    rows = {r.page_id: r for r in judged}
    assert rows[len(urls)].ratio == rows[len(urls) - 1].ratio  # a null URL is an empty one
    got = {u: rows[i].ratio for i, u in enumerate(urls)}
    ruled = {i: r.verdict for i, r in rows.items() if r.rule}
    assert ruled == {i: "allow" if "a.com/" in u or "b.com/" in u else "block" for i, u in enumerate(urls) if i not in (4, 5, 7, 8, 10, 11, 12)}
    kinds = {"good": [urls[i] for i, v in ruled.items() if v == "allow"], "bad": [urls[i] for i, v in ruled.items() if v == "block"]}
    counts = {k: Counter() for k in kinds}
    for k, texts in kinds.items():
        for t in texts:
            padded = "\x02" * 4 + t + "\x03"
            for i in range(4, len(padded)):
                for n in range(5):
                    counts[k][padded[i - n:i + 1]] += 1

    def p(k, gram):
        if len(gram) == 1:
            return Fraction(counts[k][gram] + 1, sum(c for g, c in counts[k].items() if len(g) == 1) + 256)
        context = sum(c for g, c in counts[k].items() if len(g) == len(gram) and g[:-1] == gram[:-1])
        return (counts[k][gram] + 2 * p(k, gram[1:])) / (context + 2)

    ratios = {}
    for t in set(urls):
        padded = "\x02" * 4 + t + "\x03"
        grams = [padded[i - 4:i + 1] for i in range(4, len(padded))]
        want = sum(math.log10(p("good", g)) - math.log10(p("bad", g)) for g in grams) / len(grams)
        assert got[t] == pytest.approx(want, abs=1e-9)
        ratios[t] = want
    assert len({round(ratios[urls[i]], 6) for i in (7, 8, 10, 11, 12)}) == 5
    # The verdict: on which side of the point at equal distance in standard deviations.
    (good, wide), (bad, narrow) = ((np.mean(x), np.std(x)) for x in ([ratios[u] for u in kinds[k]] for k in ("good", "bad")))
    edge = (good * narrow + bad * wide) / (wide + narrow)
    assert all(r.verdict == ("allow" if ratios[urls[i]] >= edge else "block") for i, r in rows.items() if i < len(urls) and not r.rule)


def test_mix_budgets_and_repeats(spark, docs):
    got = fair_mix(docs, part_rows=20).collect()
    assert len(got) == docs.count()
    sizes, targets, taken = Counter(), {}, Counter()
    for r in got:
        sizes[r.source] += r.size
        targets[r.source] = r.target
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, open_sources, left = {}, set(order), Fraction(sum(sizes.values()))
    while open_sources:
        level = left / sum(weight[s] for s in open_sources)
        full = {s for s in open_sources if level * weight[s] > 3 * sizes[s]}
        if not full:
            want |= {s: level * weight[s] for s in open_sources}
            break
        for s in full:
            want[s] = Fraction(3 * sizes[s])
            left -= want[s]
        open_sources -= full
    for s in order:
        assert targets[s] == pytest.approx(float(want[s]))
        assert abs(taken[s] - targets[s]) <= max(r.size for r in got if r.source == s)
    assert sum(taken.values()) <= sum(sizes.values())
    again = sorted(map(repr, fair_mix(docs, part_rows=7).collect()))
    assert again == sorted(map(repr, got))
    assert fair_mix(docs.limit(0)).count() == 0
    blank = fair_mix(docs.filter("doc_id in (1, 2)")).collect()
    assert [(r.size, r.taken) for r in blank] == [(0, 0)] * 2


def test_shards_are_even_whole_and_gapless(spark, docs):
    text = F.coalesce("text", F.lit("")).cast("binary")
    size, crc = F.octet_length(text) + 8, F.crc32(text)
    many = docs.filter("doc_id >= 10").crossJoin(spark.range(40).withColumnRenamed("id", "k")).withColumn("text", F.when(F.col("k") < 13, "hot copy").otherwise(F.concat("text", "k")))
    for df, shards in ((many, 24), (docs, 24), (docs.limit(0), 5), (docs.filter("doc_id = 4"), 3), (docs, 1)):
        got = kd_shards(df, shards, size, [size, crc], crc, slot_rows=9).collect()
        assert len(got) == df.count()
        weight, slots, homes = Counter(), defaultdict(list), defaultdict(set)
        for r in got:
            assert 0 <= r.shard < shards
            weight[r.shard] += r.size
            slots[r.shard].append(r.slot)
            homes[r.grp].add(r.shard)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        if df is many:
            mean = sum(weight.values()) / shards
            assert max(abs(weight[s] - mean) for s in range(shards)) < 0.05 * mean
            # A group is spread only as far as it is heavier than a shard.
            assert sum(len(h) > 1 for h in homes.values()) <= 1


def test_document_dimensions(spark):
    rows = [(1, "aé b", "en", "web"), (2, "aé b", "de", None), (3, "aé b", "fr", "books"), (4, None, None, None), (5, "", "en", "web"), (6, "x", None, "webcrawler-1"), (7, "y", None, "webcrawler-2")]
    docs = spark.createDataFrame([(*r, 9, 9) for r in rows], "doc_id long, text string, lang string, source string, size long, grp long")
    placed, dimensions = document_dimensions(docs)
    got = {r.doc_id: tuple(r)[1:] for r in placed.select("doc_id", "own_size", "own_group", *dimensions).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7}
    # Equal texts have one point: the first source and language by code point, null first.
    assert got[1] == got[2] == got[3] and got[4] == got[5]
    assert got[1][0] == 13 and got[4][0] == 8 and got[1][1] == zlib.crc32("aé b".encode())
    assert [got[i][2:4] for i in (1, 4, 6)] == [(13, 4), (8, 0), (9, 1)]
    assert got[2][4] == got[4][4] < got[6][4] == got[7][4]  # no source; then names by their first seven bytes
    assert document_dimensions(docs.limit(0))[0].count() == 0


def brute_shards(rows, shards, dims):
    """(shard of each row): exact weighted medians over (dimension, group, row), the widest dimension first."""
    spans = [max(1, max(r[2][d] for r in rows) - min(r[2][d] for r in rows)) for d in range(dims)]

    def split(part, first, n):
        if n == 1 or not part:
            return [(r, first) for r in part]
        wide = [(max(r[2][d] for r in part) - min(r[2][d] for r in part)) / spans[d] for d in range(dims)]
        axis = wide.index(max(wide))
        part = sorted(part, key=lambda r: (r[2][axis], r[1], r[3]))
        need, seen, at = sum(r[0] for r in part) * (n // 2) // n, 0, 0
        while at < len(part) and seen + part[at][0] <= need:
            seen += part[at][0]
            at += 1
        if at < len(part) and seen + part[at][0] - need < need - seen:
            at += 1
        return split(part[:at], first, n // 2) + split(part[at:], first + n // 2, n - n // 2)

    return split(rows, 0, shards)


def test_shards_are_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.randint(1, 40), 1000 + i, (rng.randint(0, 500), rng.randint(0, 90)), i) for i in range(700)]
    df = spark.createDataFrame([(i, size, g, *d) for size, g, d, i in rows], "doc_id long, size long, g long, x long, y long")
    got = {r.id: r.shard for r in kd_shards(df, 24, F.col("size"), [F.col("x"), F.col("y")], F.col("g"), tolerance=0.0).collect()}
    assert got == {r[3]: shard for r, shard in brute_shards(rows, 24, 2)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_agree_with_duckdb(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    base = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = base.execute("SELECT " + ", ".join(columns) + f" FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want))
