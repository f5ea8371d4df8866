"""Scores, labels, pieces and fingerprints of texts against brute force."""

import math
import random
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from rehome.llm.katz import END, REST, Part, deal_pairs, discounted, frame, hashes, katz_scores, unframe
from rehome.llm.language import ByteGru, identify, predict_language, sequences, windows
from rehome.llm.pieces import Paths, decode_ids, encode_texts, load_model, packs, unpacked, word_edges
from rehome.llm.quality import judge_quality
from rehome.llm.queries import PIECE_MODEL
from rehome.llm.simhash import simhash_groups


def words_of(text):
    return (text or "").encode().lower().split()


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def brute_katz(rows):
    one, two = Counter(), Counter()
    for doc_id, text in rows:
        before = None
        if doc_id is None or crc(doc_id) % 7 != 2:
            for w in [*words_of(text), b""]:
                one[w] += 1
                two[before, w] += 1
                before = w
    total, types = sum(one.values()), len(one)

    def table(counts):
        return discounted([sum(c == r for c in counts.values()) for r in range(7)])

    d1, d2 = table(one), table(two)
    give = lambda c, d: d[c] if c < len(d) else c - REST
    p1 = {w: give(c, d1) / total for w, c in one.items()}
    unknown = 1 - sum(p1.values())
    seen, size = defaultdict(list), Counter()
    for (h, w), c in two.items():
        seen[h].append(w)
        size[h] += c
    weight = {h: (1 - sum(give(two[h, w], d2) for w in ws) / size[h]) / (1 - sum(p1[w] for w in ws)) for h, ws in seen.items()}

    def p(h, w):
        return give(two[h, w], d2) / size[h] if (h, w) in two else weight.get(h, 1.0) * p1.get(w, unknown)

    out = []
    for doc_id, text in rows:
        before, score, base, known = None, 0.0, 0.0, 0
        tokens = [*words_of(text), b""]
        for w in tokens:
            score += math.log10(p(before, w))
            base += math.log10((one[w] + 1) / (total + types + 1))
            known += w in one
            before = w
        out.append((doc_id, len(tokens), known, total, base, score))
    return out, p, one


@pytest.mark.parametrize("part_tokens", [4_000_000, 2000])
def test_katz_is_brute_force(spark, docs, odd_texts, part_tokens):
    want, p, one = brute_katz(odd_texts)
    for history in [None, b"the", b"casa"]:
        assert sum(p(history, w) for w in [*one, b"not a word"]) == pytest.approx(1, abs=1e-9)
    got = katz_scores(docs, part_tokens=part_tokens).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    for g, w in zip(sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key), sorted(want, key=key), strict=True):
        assert g[:4] == w[:4]
        assert g[4:] == pytest.approx(w[4:], abs=1e-8)
    assert {r.doc_id for r in got if r.held_out} == {i for i, _ in odd_texts if i is not None and crc(i) % 7 == 2}


def brute_trigrams(rows):
    """Order 3, written down from the definition on top of the bigrams of brute_katz."""
    _, p2, one = brute_katz(rows)
    three = Counter()
    for doc_id, text in rows:
        if doc_id is None or crc(doc_id) % 7 != 2:
            tokens = [None, *words_of(text), b""]
            three.update(zip(tokens, tokens[1:], tokens[2:]))
    d3 = discounted([sum(c == r for c in three.values()) for r in range(7)])
    give = lambda c: d3[c] if c < len(d3) else c - REST
    behind, size = defaultdict(list), Counter()
    for (g, h, w), c in three.items():
        behind[g, h].append(w)
        size[g, h] += c
    weight = {k: (1 - sum(give(three[*k, w]) for w in ws) / size[k]) / (1 - sum(p2(k[1], w) for w in ws)) for k, ws in behind.items()}

    def p(g, h, w):
        return give(three[g, h, w]) / size[g, h] if (g, h, w) in three else weight.get((g, h), 1.0) * p2(h, w)

    scores = []
    for doc_id, text in rows:
        tokens = [None, *words_of(text), b""]
        scores.append((doc_id, math.log10(p2(None, tokens[1])) + sum(math.log10(p(*t)) for t in zip(tokens, tokens[1:], tokens[2:]))))
    return scores, p, one


@pytest.mark.parametrize("part_tokens", [3_000_000, 500])
def test_katz_of_order_three_is_brute_force(spark, docs, odd_texts, part_tokens):
    want, p, one = brute_trigrams(odd_texts)
    for g, h in [(None, b"the"), (b"of", b"the"), (b"not a word", b"the"), (b"casa", b"river")]:
        assert sum(p(g, h, w) for w in [*one, b"not a word"]) == pytest.approx(1, abs=1e-9)
    got = katz_scores(docs, part_tokens=part_tokens, order=3).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    for g, w in zip(sorted(((r.doc_id, r.score) for r in got), key=key), sorted(want, key=key), strict=True):
        assert g[0] == w[0] and g[1] == pytest.approx(w[1], abs=1e-8)
    assert sorted(r.base_score for r in got) == pytest.approx(sorted(r.base_score for r in katz_scores(docs).collect()), abs=1e-8)


def test_katz_sums_do_not_grow_with_documents_times_parts(spark):
    docs = spark.range(1, 3001, 1, 1).selectExpr("id AS doc_id", "concat('w', id % 997, ' v', id % 89, ' u') AS text")
    whole, size = [], []
    for part_tokens in (4000, 100):
        folder = tempfile.mkdtemp(prefix="katz-")
        got = katz_scores(docs, part_tokens=part_tokens, order=3, model_folder=f"{folder}/model")
        whole.append([x for r in sorted(got.collect()) for x in r[4:]])
        sums = spark.read.parquet(f"{folder}/model/counted").filter("kind = 'sums'").select("data").collect()
        size.append(sum(len(unframe(r["data"])["d"]) for r in sums))
    assert whole[0] == pytest.approx(whole[1], abs=1e-9)
    # Four tokens a document, so at most four entries, whatever the number of parts.
    assert size[0] <= size[1] <= 4 * 3000


def test_katz_lists_are_small_in_memory_and_packed():
    texts = pa.array([" ".join(f"w{i * j % 700}" for j in range(200)) for i in range(300)])
    known = np.unique(hashes([f"w{i}" for i in range(0, 700, 2)]))
    _, lists = deal_pairs(texts, np.ones(300, bool), 4, np.array([int(END)], np.uint64), 3)
    for _, x in lists:
        plain, packed = frame(x), frame(x, known)
        assert len(packed) < len(plain) and len(frame({"h": x["h"]}, known)) < 0.7 * len(frame({"h": x["h"]}))
        for again in (unframe(plain), unframe(packed, known)):
            assert again.keys() == x.keys() and all((again[k] == x[k]).all() for k in x)
        assert all(v.itemsize <= 4 for k, v in x.items() if k not in "wh")
    part = Part([x for _, x in lists], {int(END): 300})
    # Whole hashes are held once; what goes by triple or entry has numbers of them.
    assert {v.dtype for v in (part.w, part.h, part.g, part.of_entry)} == {np.dtype(np.int32)}
    assert len(part.names) < len(part.w) and part.c3.sum() == 300 * 201


def test_frames_keep_any_numbers():
    rng = np.random.default_rng(2)
    arrays = {"a": np.unique(rng.integers(0, 2**64, 500, dtype=np.uint64)), "b": rng.integers(-5, 5, 100), "c": rng.random(50), "d": np.zeros(0, np.int64), "e": np.array([True, False]),
              "f": np.arange(12).reshape(3, 4), "g": np.array([-2**63, -1, 0, 2**63 - 1]), "h": np.array([2**64 - 1], np.uint64), "i": np.array([3, 3, 1], np.uint64)}
    for known in (arrays["a"][::3], np.zeros(0, np.uint64), arrays["h"]):
        got = unframe(frame(arrays, known), known)
        assert got.keys() == arrays.keys() and all(got[k].shape == v.shape and (got[k] == v).all() for k, v in arrays.items())


@pytest.mark.parametrize("most_words", [0, 5, 200_000])
def test_katz_known_words_change_nothing(spark, docs, most_words):
    folder = f"{tempfile.mkdtemp(prefix='katz-')}/model"
    key = lambda r: repr(r[:4])
    want = sorted(katz_scores(docs, part_tokens=500, order=3, model_folder=folder).collect(), key=key)
    got = sorted(katz_scores(docs, part_tokens=500, order=3, most_words=most_words).collect(), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want] and [r.score for r in got] == pytest.approx([r.score for r in want], abs=1e-8)
    kinds = {r[0] for f in ("counted", "weighed", "weighed2") for r in spark.read.parquet(f"{folder}/{f}").select("kind").distinct().collect()}
    assert {"pairs", "triples", "stats", "backoff", "backoff2"} <= kinds


def test_katz_lists_of_missed_histories_do_not_grow_with_batches(spark):
    docs = spark.range(1, 1201, 1, 12).selectExpr("id AS doc_id", "concat('w', id * 31 % 197, ' v', id % 89, ' w', id * 17 % 211, ' u w', id % 7) AS text")
    folder = f"{tempfile.mkdtemp(prefix='katz-')}/model"
    got = katz_scores(docs, part_tokens=1500, order=3, model_folder=folder)
    counts = {r[0]: r[1] for r in spark.read.parquet(f"{folder}/counted").groupBy("kind").count().collect()}
    parts = counts["counts3"]
    assert parts > 3 and 0 < counts["missed"] <= parts**2 and 0 < counts["missed2"] <= parts**2
    want = katz_scores(docs.coalesce(1), part_tokens=10**6, order=3).collect()
    assert [r.score for r in sorted(got.collect())] == pytest.approx([r.score for r in sorted(want)], abs=1e-8)


def test_katz_of_nothing(spark, docs):
    assert katz_scores(docs.limit(0)).count() == 0


def test_good_turing_discounts():
    d = discounted([0, 100, 40, 20, 12, 8, 6])
    n, r = [0, 100, 40, 20, 12, 8, 6], np.arange(6)
    assert all(0 < d[i] < i for i in r[1:])
    # Katz: the small counts together give up as much as the count-1 share.
    assert sum(n[i] * (i - d[i]) for i in r[1:]) == pytest.approx(n[1])


def brute_print(text):
    words = words_of(text)
    if not words:
        return 0
    parts = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in parts]
    return sum(1 << k for k in range(64) if 2 * sum(v >> k & 1 for v in hashes) > len(hashes))


def test_simhash_is_brute_force(spark, docs, odd_texts):
    rows = [(i, brute_print(t)) for i, t in odd_texts]
    near = {}
    for i, a in rows:
        near.setdefault(i, i)
    changed = True
    while changed:
        changed = False
        for i, a in rows:
            for j, b in rows:
                if i is not None and j is not None and (a ^ b).bit_count() <= 4 and near[j] < near[i]:
                    near[i], changed = near[j], True
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash_groups(docs, block_rows=16).collect())
    assert got == sorted((str(i), f"{b:016x}", near[i] if i is not None else None) for i, b in rows)
    assert simhash_groups(docs.limit(0)).count() == 0


def test_near_fingerprints_link_across_tiles():
    from rehome.llm.simhash import near_in_tiles

    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    flipped = base ^ (np.uint64(1) << rng.integers(0, 63, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 400).astype(np.uint64))
    both = np.unique(np.concatenate([base, flipped]))
    want = {(int(a), int(b)) for a in both for b in both if a < b and (int(a) ^ int(b)).bit_count() <= 4}
    ids, roots = near_in_tiles(both, both, 4, True, tile=32)
    root = dict(zip(ids.view(np.uint64).tolist(), roots.tolist()))
    assert all(root[a] == root[b] for a, b in want) and len(root) == len({x for p in want for x in p})


def brute_pieces(model, text):
    table, longest, unknown = {p: (i, s) for p, i, s in zip(model.pieces, model.ids, model.scores)}, model.longest, model.unknown
    text = " " + (text or "")
    best = [(0.0, 0, 0)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for size in range(min(longest, end), 0, -1):
            i, score = table.get(text[end - size:end], (-1, unknown) if size == 1 else (None, 0))
            if i is not None and (best[end] is None or best[end - size][0] + score > best[end][0]):
                best[end] = best[end - size][0] + score, size, i
    out, end = [], len(text)
    while end:
        _, size, i = best[end]
        out += [i] if i >= 0 else [model.first_byte + b for b in reversed(text[end - size:end].encode())]
        end -= size
    return out[::-1]


@pytest.mark.parametrize("most_words", [3_000_000, 5, 0])
def test_pieces_are_brute_force_and_round_trip(spark, docs, odd_texts, most_words):
    model = load_model(PIECE_MODEL)
    rows = encode_texts(docs, model, most_words=most_words, decoded="source").withColumnRenamed("source", "decoded").collect()
    assert [r.decoded for r in rows] == [r.decoded for r in decode_ids(encode_texts(docs, model, most_words=most_words), model).collect()] or most_words < 10
    assert len(rows) == len(odd_texts) and rows[0].size == "x"
    for r in rows:
        assert r.decoded == (r.text or "")
        assert list(r.ids) == brute_pieces(model, r.text)


def test_rare_words_reach_texts_with_runs_of_spaces_long_words_and_copies(spark):
    texts = ["a  b", " x   y ", "  ", "", None, "zq" * 50 + "  end", "zq" * 50, "only here"]
    rows = [(i, t) for i, t in enumerate(texts * 3)]
    model = load_model(PIECE_MODEL)
    got = encode_texts(spark.createDataFrame(rows, "_hash long, text string"), model, most_words=3, decoded="_fills").collect()
    assert sorted(r._hash for r in got) == [i for i, _ in rows]
    assert all(r._fills == (r.text or "") and list(r.ids) == brute_pieces(model, r.text) for r in got)


def test_texts_and_rare_words_meet_packed_in_many_shares(spark):
    rng = random.Random(3)
    words = ["the", "zq" * 40, "Été", "\U0001F600\u4e2d", *("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 12))) for _ in range(200))]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["many copies of jklmn"] * 400
    model = load_model(PIECE_MODEL)
    got = encode_texts(spark.createDataFrame(list(enumerate(texts)), "share long, text string"), model, most_words=20, part_words=50, decoded="data", share_bytes=500)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # The texts move once, packed, and are not sorted to be joined.
    assert "SortMergeJoin" not in plan and "FlatMapGroupsInArrow" in plan
    rows = got.collect()
    assert sorted(r.share for r in rows) == list(range(len(texts)))
    assert all(r.data == texts[r.share] and list(r.ids) == brute_pieces(model, texts[r.share]) for r in rows)


def test_copies_shrink_in_a_pack():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(3000))
    rows = pa.RecordBatch.from_pydict({"_text": [text] * 1000, "id": list(range(1000))})
    sent = list(packs([(np.arange(1000, dtype=np.int32) % 2, rows)], 1))
    assert [b.column("share")[0].as_py() for b in sent] == [0, 1] and sum(b.nbytes for b in sent) < 20 * len(text)
    assert [i for b in sent for x in unpacked(b.column("data")[0].as_py()) for i in x.column("id").to_pylist()] == [*range(0, 1000, 2), *range(1, 1000, 2)]


def test_paths_of_short_and_long_words_are_the_best(spark):
    rng = random.Random(6)
    model = load_model(PIECE_MODEL)
    words = [" " + "".join(rng.choice("thein \u4e2dé\U0001F600") for _ in range(n)) for n in [1, 2, 3, 9, 63, 64, 65, 66, 400, 3000, *range(4, 40)]]
    rows = spark.createDataFrame([(f"{i}", w) for i, w in enumerate(words)], "key string, long string")
    paths = Paths(model)
    for r in word_edges(rows.repartition(2, "key"), model).toArrow().to_batches():
        for key, ids in zip(r.column("key").to_pylist(), paths(r.column("edges")).to_pylist()):
            # The brute force puts a space in front of a text.
            assert ids == brute_pieces(model, words[int(key)][1:])


def test_pieces_of_nothing(spark, docs):
    model = load_model(PIECE_MODEL)
    assert encode_texts(docs.limit(0), model).count() == 0
    odd = spark.createDataFrame([(None,), ([],), ([0, -5, 10**6, 264],)], "ids array<int>")
    assert [r.decoded for r in decode_ids(odd, model).collect()] == [None, "", model.names[264].decode().removeprefix(" ")]


def test_gradient_is_the_slope():
    net = ByteGru(["a", "b", "c"], 4)
    net.w = {k: v.astype(float) for k, v in net.w.items()}
    x, y = sequences([b"abc", b"xyz", b"aab"]), np.array([0, 2, 1])
    _, grad = net.gradient(x, y)
    for k, at in [("xf", (97, 3)), ("xb", (98, 5)), ("hf", (1, 2)), ("hb", (0, 9)), ("of", (2, 1)), ("ob", (3, 0)), ("bias", (1,))]:
        value = net.w[k][at]
        net.w[k][at] = value + 1e-3
        up, _ = net.gradient(x, y)
        net.w[k][at] = value - 1e-3
        down, _ = net.gradient(x, y)
        net.w[k][at] = value
        assert grad[k][at] == pytest.approx((up - down) / 2e-3, rel=1e-3, abs=1e-7)


def test_network_pools_every_position():
    net = ByteGru(["a", "b"], 4)
    text = "ab  cdé\n" + "q" * 150
    want = np.zeros(2)
    pieces = [b"ab", "cdé".encode(), b"q" * 64, b"q" * 64, b"q" * 22]
    for w in pieces:
        want += net.probabilities(sequences([w])).sum(axis=(0, 1))
    names, scores = identify(net, pa.array([text, None, "", "123 !"]))
    assert scores[0] == pytest.approx((want / want.sum()).max(), abs=1e-5)
    assert names[1:] == ["und"] * 3 and list(scores[1:]) == [0, 0, 0]


def test_windows_cross_white_space_and_cover_every_byte():
    texts = ["ab cd\n" * 50, None, "", "é" * 300, "a中😀" * 90, "x"]
    whole = pa.array(["skipped", *texts]).slice(1)
    data, owner, first, low, high, last = windows(whole)
    for k, text in enumerate(texts):
        own = np.nonzero(owner == k)[0]
        assert b"".join(data[low[i]:high[i]].tobytes() for i in own) == (text or "").encode()
        for i in own:
            data[first[i]:last[i]].tobytes().decode(), data[low[i]:high[i]].tobytes().decode()
            assert last[i] - first[i] < 128 and (i == own[0] or low[i] - first[i] >= 11) and (i == own[-1] or last[i] - high[i] >= 11)
    net = ByteGru(["a", "b"], 4)
    want = sum(net.probabilities(sequences([data[a:b].tobytes()], -(-(b - a + 1) // 16) * 16))[low_ - a:high_ - a, 0].sum(axis=0)
               for a, low_, high_, b, o in zip(first, low, high, last, owner) if o == 4)
    names, scores = identify(net, whole, 128)
    assert scores[4] == pytest.approx((want / want.sum()).max(), abs=1e-5) and names[1] == names[2] == "und"


def test_language_by_the_order_of_words(spark):
    """Both languages have the same words; only what stands behind what tells them apart."""
    rows = [(i, ["x", "y"][i % 2], " ".join([["ka mo ti", "ti mo ka"][i % 2]] * (5 + i % 40))) for i in range(240)]
    got = predict_language(spark.createDataFrame(rows, "doc_id long, lang string, text string"), rounds=12).filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def test_language_by_held_out_accuracy(spark):
    import random

    rng = random.Random(1)
    words = {"en": ["the", "river", "with", "stone", "and", "was"], "fr": ["été", "dans", "que", "maison", "elle", "où"], "de": ["zwölf", "und", "nicht", "straße", "ein", "ich"]}
    rows = [(i, lang, " ".join(rng.choice(words[lang]) for _ in range(12))) for i in range(300) for lang in [list(words)[i % 3]]]
    df = spark.createDataFrame([*rows, (900, None, None), (901, "en", "12 34"), (900, None, None)], "doc_id long, lang string, text string")
    got = predict_language(df, rounds=12).collect()
    known = [r for r in got if r.doc_id < 900 and r.held_out]
    assert len(got) == 303 and all(r.held_out == (crc(r.doc_id) % 3 == 1) for r in got)
    assert sum(r.lang == r.lang_pred for r in known) >= 0.95 * len(known)
    assert [(r.lang_pred, r.score) for r in got if r.doc_id >= 900] == [("und", 0.0)] * 3
    assert predict_language(df.limit(0)).count() == 0
    assert {r.lang_pred for r in predict_language(df.withColumn("lang", df.lang.substr(9, 1)).filter("false").unionByName(df.selectExpr("doc_id", "cast(null as string) lang", "text"))).collect()} == {"und"}


def test_quality_by_held_out_accuracy(spark):
    import random

    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["river", "stone", "lamp", "garden", "winter", "letter", "of", "the"]) for _ in range(40))
    junk = lambda: " ".join([rng.choice(["BUY!!", "WIN$$$", "CLICK###"])] * 40)
    rows = [(i, good() if i % 3 else junk(), "kept") for i in range(240)] + [(900, None, "a"), (901, "", "b"), (901, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, predicted string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)] + [(5, 0), (6, None), (5000, 1)], "doc_id long, quality int")
    got = judge_quality(df, labels).collect()
    assert len(got) == 243 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 240]
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.95 * len(held)
    assert len({r.score for r in got if r.doc_id >= 900}) == 1
    assert {r.score for r in judge_quality(df, labels.limit(0)).collect()} == {0.5}
    assert judge_quality(df.limit(0), labels).count() == 0
