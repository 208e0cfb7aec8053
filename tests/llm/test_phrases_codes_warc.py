"""Phrase mining, vector codes and WARC archives against plain versions, on odd rows, and on empty tables."""

import collections
import gzip
import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import phrases, vector_codes, warc
from tessera.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import SMALL


def plain_phrases(rows, least, longest, first):
    """By counting all phrases, and comparing each with all longer ones."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, own in f.items():
        c = {g: a for g, a in own.items() if len(g) >= 2 and a >= least}
        inside = {g for h, b in c.items() for k in range(2, len(h)) for i in range(len(h) - k + 1) if (g := h[i : i + k]) in c and 100 * b >= 100 * c[g]}
        scored = []
        for g, a in c.items():
            if g not in inside:
                s, k = min((1000 * a * n[lang] // (own[g[:k]] * own[g[k:]]), k) for k in range(1, len(g)))
                scored.append((-s, -a, " ".join(g).encode(), own[g[:k]], own[g[k:]]))
        out += [(lang, r, p.decode(), -a, le, ri, n[lang], -s) for r, (s, a, p, le, ri) in enumerate(sorted(scored)[:first], 1)]
    return sorted(out)


def test_phrases_brute(spark):
    rng = random.Random(4)
    words = ["Über", "the", "THE", "a|b", "x" * 40, "ein", "ñu", "of", " "]
    rows = [(rng.choice([" ", "  ", "\t"]).join(rng.choice(words) + rng.choice(["", "", "", ".", "\n", "!?"]) for _ in range(rng.randrange(0, 60))), rng.choice(["en", "de", None, "und"])) for _ in range(120)]
    rows += [(None, "en"), ("", None), (" \t.. ", "de"), rows[0], rows[0]]
    df = spark.createDataFrame([(t, g, 1, "x") for t, g in rows], "text string, lang string, score int, rank string").repartition(5)
    for least, first in ((5, 2000), (3, 7)):
        got = sorted(tuple(r) for r in phrases.collocations(df, least=least, first=first).collect())
        assert got == plain_phrases(rows, least, 5, first)
    assert phrases.collocations(df.limit(0)).count() == 0


def test_phrases_whatever_the_block(spark, monkeypatch):
    """A piece that is longer than many blocks loses no phrase at their seams."""
    import pyarrow as pa

    rng = random.Random(8)
    text = " ".join(rng.choice("abc") for _ in range(3000))
    monkeypatch.setattr(phrases, "_BLOCK", 37)
    seen = collections.Counter()
    for _, _, w, n in phrases._tokenised([pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array([text, "b c"])], names=["lang", "text"])], 0):
        seen.update(tuple(g) for g in np.stack(w.grams(5, np.flatnonzero(w.follow[:n] >= 5)), 1).tolist())
    monkeypatch.undo()
    for _, _, w, n in phrases._tokenised([pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], names=["lang", "text"])], 0):
        assert seen == collections.Counter(tuple(g) for g in np.stack(w.grams(5, np.flatnonzero(w.follow[:n] >= 5)), 1).tolist())


def test_filters_lose_nothing():
    rng = np.random.default_rng(2)
    for words in (1, 2, 5):
        ids = [rng.integers(0, 1 << 64, 900, np.uint64) for _ in range(words)]
        x = phrases.permuted(ids)
        assert all((a == b).all() for a, b in zip(phrases.restored(x, ids[1:]), ids, strict=True))
        rest = np.stack(ids[1:], 1) if words > 1 else np.zeros((900, 0), np.uint64)
        x = (x >> np.uint64(4)) | np.uint64(0x7000000000000000) if words > 1 else x  # one bucket of 16
        skip = 4 if words > 1 else 0
        x[:3], rest[:3] = x[5], rest[:3] * 0 + np.uint64(9)  # unlike n-grams of one number
        count = rng.integers(1, 600, 900)
        entries = collections.Counter()
        for a, r, c in zip(x.tolist(), rest.tolist(), count.tolist(), strict=True):
            entries[(a, *r)] += c
        halves = [phrases.QuotientFilter(skip, words, *phrases.summed(x[s], rest[s], count[s])) for s in (slice(0, 500), slice(500, None))]
        again = phrases.QuotientFilter.merged([phrases.QuotientFilter.from_bytes(h.to_bytes()) for h in halves])
        assert {(a, *r): c for a, r, c in zip(again.x.tolist(), again.rest.tolist(), again.count.tolist(), strict=True)} == entries
    none = phrases.QuotientFilter(2, 3, np.zeros(0, np.uint64), np.zeros((0, 2), np.uint64), np.zeros(0, np.int64))
    assert len(phrases.QuotientFilter.from_bytes(none.to_bytes()).x) == 0


def plain_codes(rows, rounds=2):
    """Integers, all distances, Python's own floor division."""
    kept = sorted((i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v))
    ints = [[int(np.floor(256 * np.float64(np.float32(x)))) for x in v] for _, v in kept]
    w = len(ints[0]) // 16
    part = lambda v, p: v[p * w : p * w + w]
    books = [[part(v, p) for v in ints[:64]] for p in range(16)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((dist(part(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        own = [[near(v, p)[1] for v in ints] for p in range(16)]
        for p in range(16):
            for k in range(len(books[p])):
                held = [part(v, p) for v, e in zip(ints, own[p], strict=True) if e == k]
                if held:
                    own_sum = [sum(c) for c in zip(*held, strict=True)]
                    own_mean = [s // len(held) for s in own_sum]
                    books[p] = [*books[p][:k], own_mean, *books[p][k + 1 :]]
    best = [[near(v, p) for p in range(16)] for v in ints]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{k:02x}" for _, k in b), sum(d for d, _ in b)) for (i, _), b in zip(kept, best, strict=True)), digest


@pytest.mark.parametrize("n, width", [(150, 32), (20, 16), (300, 64)])
def test_codes_brute(spark, n, width):
    rng = np.random.default_rng(n)
    rows = [(int(k), (rng.normal(0, 0.05, width).round(3)).tolist()) for k in rng.permutation(n)]
    rows += [(3, None), (4, [float("nan")] * width), (5, [None] * width), (6, [float("inf")] * width), (7, []), rows[0], (n + 1, rows[1][1])]
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<float>, code long").repartition(4)
    books = vector_codes.fit_codebooks(df)
    want, digest = plain_codes(rows)
    assert vector_codes.books_digest(books) == digest
    assert sorted(tuple(r) for r in vector_codes.encode(df, books).collect()) == want


def test_codes_assign_whole_nodes():
    """Points in tight groups are assigned by their nodes, not one by one."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (16, 4))
    rows = (centres[rng.integers(0, 16, 4000)] + rng.integers(-3, 4, (4000, 4))).astype(np.int64)
    tree = vector_codes.DualTree(centres)
    points = vector_codes.BoxTree.over(rows, 16)
    whole = sum(int(points.count[level][nodes].sum()) for level, nodes, _ in tree.pairs(points) if level is not None)
    assert whole > 2000
    want = ((rows[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert (tree.nearest(rows) == want).all() and (tree.sums(rows)[0] == np.bincount(want, minlength=16)).all()


def test_codes_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.fit_codebooks(spark.createDataFrame([(1, None, 1)], schema)) is None
    assert vector_codes.fit_codebooks(spark.createDataFrame([], schema)) is None
    for bad in ([1.0] * 15, [1e6] * 16):
        df = spark.createDataFrame([(1, [0.0] * 16, 1), (2, bad, 1)], schema)
        with pytest.raises(Exception, match="vectors must all have one width|components must be below"):
            vector_codes.encode(df, vector_codes.fit_codebooks(df)).collect()


PAGES = [
    (5, "http://a/ü b\r\nX: y", "<p>" + "gleich " * 40), (2, None, "<p>" + "gleich " * 40), (9, "http://b", "<p>" + "gleich " * 40), (1, "http://c", "short"), (3, "http://c", "short"), (4, None, None), (6, "u", ""),
    (7, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\n" + "ü€😀" * 30_000), (8, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\n" + "ü€😀" * 30_000), (None, "u", "<p>" + "gleich " * 40), (2, "again", "<p>" + "gleich " * 40), (10, "u", "x" * (1 << 16)), (11, "u", "0\r\n\r\n" * 50),
]


def plain_pages(rows):
    least = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 100 and i is not None:
            least[h] = min(i, least.get(h, i))
    out = []
    for i, _, h in rows:
        data, first = (h or "").encode(), least.get(h or "")
        again = first is not None and first != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return out


def by_text(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("segment", [1 << 16, 1000])
def test_warc_round_trip(spark, tmp_path, segment):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    path = str(tmp_path / "archives")
    warc.write_warc(df, path, segment_bytes=segment, records_a_file=4)
    rows = warc.read_warc(spark, path).collect()
    assert all(r.problem is None for r in rows)
    assert by_text((None if r.page is None else int(r.page), r.payload_bytes, r.payload_digest, r.record_type, None if r.refers is None else int(r.refers)) for r in rows) == by_text(plain_pages(PAGES))
    assert by_text((r.page, bytes(r.payload)) for r in rows) == by_text((None if i is None else str(i), (h or "").encode()) for i, _, h in PAGES)
    assert len([r for r in rows if r.record_type == "revisit"]) == 4
    files = [gzip.decompress(p.read_bytes()) for p in (tmp_path / "archives").glob("part-*")]
    assert all(sum(1 for _ in warc.parse_records(f)) <= 4 for f in files)
    parts = [h for f in files for h, _ in warc.parse_records(f) if h["warc-type"] == "continuation"]
    assert len(parts) >= (1 if segment > 1000 else 200) and sum("warc-segment-total-length" in h for h in parts) == sum(len((h or "").encode()) + 200 > segment for i, _, h in PAGES if i in (7, 10))


def test_warc_broken_archives(spark, tmp_path):
    """A missing segment, a wrong total and a wrong digest keep their rows and say so."""
    df = spark.createDataFrame([(k, "u", f"{k}" * 5000) for k in range(1, 5)], "page_id long, url string, html string").coalesce(1)
    path = tmp_path / "archives"
    warc.write_warc(df, str(path), segment_bytes=1500)
    (file,) = path.glob("part-*")
    records = list(warc.parse_records(gzip.decompress(file.read_bytes())))
    out = []
    for h, b in records:
        first = next(b2 for h2, b2 in records if h2["warc-record-id"] == h.get("warc-segment-origin-id", h["warc-record-id"]))
        k = int(first.partition(b"\r\n\r\n")[2].partition(b"\r\n")[2][:1])
        if (k == 1 and h["warc-segment-number"] == "2") or (k == 4 and h["warc-segment-number"] == "1"):
            continue
        if k == 2 and "warc-segment-total-length" in h:
            h = h | {"warc-segment-total-length": "7"}
        if k == 3 and "warc-payload-digest" in h:
            h = h | {"warc-payload-digest": "sha256:00"}
        out.append(warc.record([(n, v) for n, v in h.items() if n != "content-length"], b))
    file.write_bytes(b"".join(out))
    for crc in path.glob(".*.crc"):
        crc.unlink()
    rows = {r.page: r for r in warc.read_warc(spark, str(path)).collect()}
    assert "segments are [1, 3" in rows["1"].problem and rows["1"].payload is None
    assert "of 7" in rows["2"].problem and "digest" in rows["3"].problem and rows[None].problem == "first segment missing"


def test_warc_framing():
    for data in (b"", b"a", b"x" * 20_000):
        assert warc.unchunked(warc.chunked(data)) == data
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b""):
        with pytest.raises(ValueError):
            warc.unchunked(bad)


def test_warc_empty(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).count() == 0


@pytest.mark.parametrize("name", ["op11_collocations", "op12_vector_codes", "op13_warc"])
def test_queries_match_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    found = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    assert by_text(tuple(r[c] for c in names) for r in df.collect()) == by_text(found.fetchall())
