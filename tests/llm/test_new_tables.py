"""Prefix tree, whitening and web archives against plain Python and numpy."""

import base64
import glob
import gzip
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from rehome.llm.archives import arc_records, archived_pages, convert_archives, gzipped, read_arc, read_warc, warc_date
from rehome.llm.prefix_trie import conversation_turns, prefix_trie, shared_starts
from rehome.llm.whitening import jacobi_davidson, whiten


def turn_order(row):
    _, turn, role, text = row
    role, text = role or "", text or ""
    return (turn is not None, turn or 0), hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]


def plain_trie(rows):
    convs = defaultdict(list)
    for row in sorted((r for r in rows if r[0] is not None), key=turn_order):
        convs[row[0]].append((row[2] or "", row[3] or ""))
    rebuilt = {}
    for c, turns in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(np.fmod(c, 100))
        rebuilt[c] = tuple(convs[base][:h] if base in convs else []) + tuple(turns[h:])
    members, children = defaultdict(list), defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[x] for x in children[path]) if children[path] else 1
        saved[path] = (len(members[path]) - 1) * (len(path[-1][1]) if path else 0) + sum(saved[x] for x in children[path])
    out = []
    for path, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(path))
        out.append((min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(children[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def odd_conversations():
    rng = random.Random(3)
    rows = [(rng.choice([0, 1, 2, 3, 100, 101, 5, -7, 250, None]), None if i % 50 == 0 else i // 2, rng.choice(["a", None, "b"]), rng.choice(["x", "", "yy", None, "é\U0001F600"])) for i in range(300)]
    rows += [(1000 + i % 60, i, rng.choice("ab"), rng.choice("xyz")) for i in range(600)]
    rows += [(100000 + i * 100, t, "u", "same" * (t + 1)) for i in range(400) for t in range(3)]  # a hot group of copies
    rows += [(500, t, "u", "deep") for t in range(150)] + [(501, t, "u", "long " * 20000) for t in range(2)]
    return rows + rows[:3]


@pytest.mark.parametrize("shard_turns", [40, 300, 10**6])
def test_trie_is_that_of_plain_python(spark, rows, shard_turns):
    data = odd_conversations()
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in data], "conv_id long, turn long, role string, text string, depth int, key string, shard int")
    assert rows(prefix_trie(shared_starts(conversation_turns(df)), shard_turns)) == plain_trie(data)


def test_trie_of_nothing_and_of_no_turns(spark, rows):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert rows(prefix_trie(shared_starts(conversation_turns(empty)))) == []
    lone = [(c, 0, "u", "t") for c in range(1, 9)]  # those with h > 0 lose their only turn: there is no conversation 0
    assert rows(prefix_trie(shared_starts(conversation_turns(spark.createDataFrame(lone, empty.schema))))) == plain_trie(lone)


@pytest.mark.parametrize("width, count", [(64, 32), (160, 20), (5, 32), (1, 3), (90, 2)])
def test_solver_is_numpys(width, count):
    rng = np.random.default_rng(width)
    a = rng.standard_normal((3 * width, width)) * np.linspace(1, 3, width)
    a = a.T @ a / (3 * width)
    values, vectors, residuals = jacobi_davidson(lambda x: a @ x, width, count)
    true = np.linalg.eigh(a)[0][::-1][:count]
    assert np.abs(values - true).max() < 1e-12 * true[0]
    assert residuals.max() <= 1e-12 * true[0]
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_solver_finds_equal_and_zero_values():
    a = np.diag([4.0, 4, 4, 1, 0, 0])
    assert np.allclose(jacobi_davidson(lambda x: a @ x, 6, 5)[0], [4, 4, 4, 1, 0], atol=1e-13)


def test_whitening_is_numpys(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((700, 40)) @ rng.standard_normal((40, 40)) / 7
    v[:200] = v[200]  # a hot vector
    df = spark.createDataFrame([(i, r, 0.0, 7) for i, r in enumerate(v.tolist())], "vec_id long, embedding array<double>, whitened double, n int").repartition(5)
    found = whiten(df).toPandas()
    x = np.floor(64 * v).astype(np.int64) + 1000000
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1], axes[:, ::-1]
    w = found.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = y @ axes[:, :32] / np.sqrt(values[:32])
    assert np.abs(w * np.sign((w * want).sum(axis=0)) - want).max() < 1e-9
    assert (found.groupby("vec_id")["deviation"].first().to_numpy() == ((n * x - s) ** 2).sum(axis=1)).all()
    assert np.allclose(found.groupby("component")["explained"].first(), values[:32] / values.sum(), rtol=1e-9)
    assert found["identity_error"].max() < 1e-9 and (found["n"] == n).all() and len(found) == 700 * 32


def test_whitening_of_odd_vectors(spark, rows):
    data = [(1, [1.0, 2.0]), (2, [3.0, 1.0]), (None, [0.5, 0.25]), (2, [3.0, 1.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [1e300, 1.0]), (7, []), (8, [1.0]), (9, [4.0]), (10, [7.0] * 3)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found = rows(whiten(df), "vec_id", "component", "n", "deviation")
    assert found == sorted([(1, c, 4, 107776) for c in (1, 2)] + [(2, c, 4, 83200) for c in (1, 2)] * 2 + [(None, c, 4, 167168) for c in (1, 2)] + [(8, 1, 2, 36864), (9, 1, 2, 36864)], key=repr)
    assert rows(whiten(df.limit(0))) == [] and rows(whiten(df.filter("vec_id = 2"))) == []
    far = spark.createDataFrame([(1, [1e13, 0.0]), (2, [-1e13, 1.0]), (3, [5e12, 2.0])], df.schema)
    assert {r[3] for r in rows(whiten(far), "vec_id", "component", "n", "deviation")} == {None}


def plain_archive(data):
    first = {}
    for i, _, html in sorted(data, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault((html or "").encode(), i)
    taken, out = set(), []
    for i, _, html in data:
        body = (html or "").encode()
        again = first[body] != i or body in taken
        taken |= set() if again else {body}
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first[body] if again else None))
    return sorted(out, key=repr)


def test_archives_are_those_of_plain_python(spark, rows, tmp_path):
    data = [(1, "http://a b\n", "x"), (2, None, None), (3, "u", ""), (9, "u", "dup"), (7, "v", "dup"), (7, "v", "dup"), (None, "v", "dup"), (None, None, "only"),
            (11, "u", "HTTP/1.1 200\r\n\r\n"), (12, "é", "é" * 200000), (13, "z", "\x00\x01\n\n\r\n\r\nWARC/1.1\r\n"), (110, "dns:x", "x")]
    data += [(1000 + i, f"http://h/{i}", f"copy {i % 3}") for i in range(300)]
    df = spark.createDataFrame([(*r, "q", 5) for r in data], "page_id long, url string, html string, key string, digest int").repartition(3)
    found = archived_pages(df, str(tmp_path / "a"), file_bytes=100_000)
    assert rows(found, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == plain_archive(data)
    assert found.filter("NOT sound").isEmpty()
    files = [gzip.decompress(open(f, "rb").read()) for f in glob.glob(str(tmp_path / "a/arc/*/part*"))]
    assert {f.split(b"\n")[1][:2] for f in files} == {b"1 ", b"2 "}
    found = archived_pages(df, str(tmp_path / "b"), least_bytes=5)
    assert found.filter("record_type = 'revisit' AND payload_bytes < 5").isEmpty() and found.filter("record_type = 'revisit'").count() == 297
    assert rows(archived_pages(df.limit(0), str(tmp_path / "c"))) == []


def test_archives_of_older_makers(spark, rows, tmp_path):
    """Twelve-digit dates, URLs with blanks, DNS answers, cut records and broken lines, plain and gzipped."""
    about = b"1 1 Maker\nURL IP-address Archive-date Content-type Archive-length\n<xml/>\n"
    body = b"HTTP/1.0 200 OK\nA: b\n\nhello"
    lines = [(b"http://x/a b 1.2.3.4 199912312359 text/html", body), (b"dns:x 1.2.3.4 20010203040506 text/dns", b"x. IN A"), (b"ftp://x/f 1.2.3.4 2001 text/plain", b"")]
    arc = b"filedesc://old.arc 0.0.0.0 19990101 text/plain %d\n" % len(about) + about + b"\n"
    arc += b"".join(line + b" %d\n" % len(block) + block + b"\n" for line, block in lines)
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc/old.arc").write_bytes(arc + b"http://x/cut 1.2.3.4 20010101000000 text/html 99\nHTTP/1.0 200\n\nshort")
    (tmp_path / "arc/old2.arc.gz").write_bytes(b"".join(map(gzipped, (arc, b"no length here\n"))))
    (tmp_path / "arc/none.arc").write_bytes(b"<html>")
    (tmp_path / "arc/empty.arc").write_bytes(b"")
    bad = convert_archives(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    assert sorted(r["error"] for r in bad.collect()) == ["cut short", "no record line", "no version block"]
    found = rows(read_warc(spark, str(tmp_path / "warc")), "url", "record_type", "date", "payload_bytes", "sound")
    assert found == sorted([("http://x/a b", "response", "1999-12-31T23:59:00Z", 5, True), ("http://x/a b", "revisit", "1999-12-31T23:59:00Z", None, True),
                            ("dns:x", "response", "2001-02-03T04:05:06Z", 7, True), ("dns:x", "revisit", "2001-02-03T04:05:06Z", None, True),
                            ("ftp://x/f", "resource", "2001-01-01T00:00:00Z", 0, True), ("ftp://x/f", "resource", "2001-01-01T00:00:00Z", 0, True),
                            ("http://x/cut", "response", "2001-01-01T00:00:00Z", 5, True)], key=repr)
    again = read_arc(spark, str(tmp_path / "arc")).select("record_id")
    assert rows(again) == rows(read_arc(spark, str(tmp_path / "arc"), payloads=False).select("record_id"))


def test_arc_lines_by_version():
    two = b"filedesc://a 0 2 t %d\n2 0 x\n\n" % 7 + b"http://u 1.1.1.1 20000101000000 t 200 - - 0 f 3\nabc\n"
    assert [(r.fields["URL"], r.fields["Result-code"], r.block) for r in arc_records(two)] == [("http://u", "200", b"abc")]
    assert [r.error for r in arc_records(two.replace(b"\n2 0", b"\n9 0"))] == ["version 9 is not known"]
    assert warc_date("x") == warc_date("20001399000000") == "1970-01-01T00:00:00Z"
