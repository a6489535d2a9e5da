"""The operators of the pipeline on small tables, against brute force where SQL can't state them."""

import gzip
import hashlib
import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.llm import bpe, chat, components, decontam, linededup, neardup, passages, quality, sharding, topk, warc
from tracewell.llm.common import Scratch
from tracewell.llm.queries import CHAT_RANKS, MULTI_RANKS, PATTERN
from tracewell.llm import shingles as shingle_module
from tracewell.llm.shingles import hash_words, runs_of, shingles, words

RANKS = MULTI_RANKS
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score int, row string"
ODD = ["", None, "one", " \n\t ", "zwei Wörter", "日本語 😀 text", "￿ mark", "x" * 200_000, "und " * 3000]


def table(spark, texts, first=0):
    return spark.createDataFrame([(i + first if i is not None else None, t, "en", "s", 0, 1, "r") for i, t in enumerate(texts)], DOCS)


def sentences(rng, n, words=60):
    return [" ".join(rng.choice(["ka", "lo", "mi", "ne", "pu", "ra", "so", "te"]) + str(rng.randrange(400)) for _ in range(words)) for _ in range(n)]


def test_sharding(spark):
    docs = table(spark, ["a", "a", None, "é"] * 50).union(table(spark, ["a"])).union(table(spark, ["a"]))
    rows = sharding.shard_documents(docs, 24).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(rows) == 202
    assert {r.text_crc32 for r in rows} == {zlib.crc32(x) for x in (b"a", b"", "é".encode())}
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_rendezvous_weights(spark):
    got = spark.range(20_000).select(sharding.rendezvous(F.col("id"), [1.0, 3.0]).alias("s")).groupBy("s").count().collect()
    assert abs({r.s: r["count"] for r in got}[1] / 20_000 - 0.75) < 0.02


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(300)] + [(300, [0.0] * 6), (301, None), (302, [1.0, None] * 3), (303, [float("nan")] * 6), (304, [0.5] * 5), (305, [])]
    vectors += [(400 + i, vectors[7][1]) for i in range(8)] + [(0, vectors[0][1])]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    got = defaultdict(list)
    for r in topk.search(df, F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    whole = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vectors if v and len(v) == 6 and None not in v and np.isfinite(v).all()}
    for q in [i for i in whole if i % 50 == 0]:
        best = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:5]
        assert got[q] == [(i, -s) for s, i in best]
    assert topk.search(df.limit(0), F.lit(True)).count() == 0


def test_topk_of_large_components(spark):
    rng = np.random.default_rng(15)
    rows = [[float(np.float32(x)) for x in rng.normal(size=4) * rng.choice([1, 4096, 3e5])] for _ in range(300)]
    rows += [[float(np.float32(x)) for x in [2.0**20, 1e5 + i / 128, -(2.0**20), 1.0]] for i in range(20)]  # near ties of large terms
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id bigint, embedding array<float>")
    got = defaultdict(list)
    for r in topk.search(df, F.col("vec_id") % 10 == 0, 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    whole = [[int(np.floor(256 * x)) for x in v] for v in rows]
    for q in range(0, len(rows), 10):
        best = sorted((-sum(x * y for x, y in zip(whole[q], v)), i) for i, v in enumerate(whole) if i != q)[:5]
        assert got[q] == [(i, -s) for s, i in best]
    beyond = spark.createDataFrame([(0, [1e30]), (1, [1.0])], "vec_id bigint, embedding array<float>")
    with pytest.raises(Exception, match="beyond bigint"):
        topk.search(beyond, F.lit(True), 5).collect()


def test_scan_against_whole_numbers():
    rng = np.random.default_rng(16)
    rows = np.floor(rng.normal(size=(200, 3)) * 2.0**40) * 2.0 ** rng.integers(0, 3, (200, 1))
    rows[100:] = rows[:100]
    query = np.floor(rng.normal(size=3) * 2.0**40)
    block = topk.Block(np.arange(200), rows, topk.Block.sort(rows))
    expected = sorted((-sum(int(x) * int(y) for x, y in zip(row, query)), i) for i, row in enumerate(rows) if i != 7)[:9]
    ids, scores, _ = block.search(query, 9, 7)
    assert list(zip(ids.tolist(), scores.tolist())) == [(i, -s) for s, i in expected]


def test_quality(spark):
    rng = random.Random(1)
    good = sentences(rng, 60)
    texts = [t.capitalize() + "." if i % 2 else t.upper().replace(" ", "!! ") for i, t in enumerate(good)] + ODD
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (7, None, 0), (10_000, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = quality.digest_scores(table(spark, texts), labels).orderBy("doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == r.doc_id % 2 for r in rows[:60] if r.held_out)
    model = quality.train(table(spark, texts), labels)
    kept = quality.keep_good(table(spark, texts), model)
    assert kept.columns == table(spark, []).columns and {r.doc_id for r in kept.collect()} >= set(range(1, 60, 2))
    scored = quality.score(table(spark, texts), model)
    assert 0 < quality.keep_best(scored, 0.5).count() < len(texts) and "row" in scored.columns
    assert quality.digest_scores(table(spark, texts), labels.limit(0)).count() == len(texts)


def test_bpe_matches_the_library(spark):
    import tiktoken

    library = tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    texts = [*ODD, "It's we'll 123 ²³ Ⅷ  \n\n x", "a" * 5000]
    for r, text in zip(bpe.digest_documents(table(spark, texts).coalesce(1), RANKS, PATTERN).collect(), texts):
        ids = library.encode_ordinary(text or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert all(r.decodes for r in bpe.encode_checked(table(spark, texts), RANKS, PATTERN).collect())


def test_bpe_of_a_vocabulary_that_merges_miss():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256}
    codec = bpe.ByteBpe(ranks, r"\w+|\W")
    assert codec.encode("abc abcd").tolist() == [256, 32, 97, 98, 99, 100] and codec.decode([256, 32]) == b"abc "


def test_bpe_of_texts_that_leave_no_mark():
    import tiktoken

    library = tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    codec = bpe.ByteBpe(bpe.load_ranks(RANKS), PATTERN)
    chart = "".join(map(chr, range(0xE001, 0x10000)))
    for text in (chart, " ".join(chart), f"and {chart} so {chart[:3000]}"):
        assert codec.encode(text).tolist() == library.encode_ordinary(text)


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/ x", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u\r\nX: y", "big" * 100_000), (None, "u", "<p>é</p>")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    rows = {r.page_id: r for r in warc.round_trip(df).collect()}
    assert len(rows) == 6 and (rows[1].record_type, rows[1].refers_to, rows[2].record_type) == ("revisit", 2, "response")
    assert rows[3].refers_to == 4 and rows[None].refers_to == 2
    for i, _, text in pages:
        assert rows[i].payload_bytes == len((text or "").encode()) and rows[i].payload_digest == warc.digest32((text or "").encode())
    assert warc.round_trip(df.limit(0)).count() == 0
    warc.write_archives(df, f"file://{tmp_path}/a", min_payload=10**6)
    assert {r.record_type for r in warc.read_archives(spark, f"file://{tmp_path}/a").collect()} == {"response"}


def test_archives_are_read_by_ranges_or_whole(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, "u", f"<p>{i % 7}</p>" * 50) for i in range(60)], "page_id bigint, url string, html string")
    warc.write_archives(df.coalesce(2), f"file://{tmp_path}/a", archive_bytes=900)
    rows = []
    for ranged in (True, False):
        monkeypatch.setattr(warc, "_ranged", lambda _, ranged=ranged: ranged)
        rows.append(sorted(map(tuple, warc.read_archives(spark, f"file://{tmp_path}/a").collect())))
    assert rows[0] == rows[1] and len(rows[0]) == 60 and len(list(tmp_path.glob("a/part-*"))) > 3


def test_zip64_directory():
    """An archive whose end record, sizes and offsets all refer to the ZIP64 fields, made byte by byte."""
    import struct

    data = [(warc.DATA, b"x" * 1000), (warc.INDEX, b"y" * 10)]
    out, central, full = b"", b"", 0xFFFFFFFF
    for name, body in data:
        extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), len(out))
        central += b"PK\x01\x02" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, full, full, len(name), len(extra), 0, 0, 0, 0, full) + name.encode() + extra
        out += b"PK\x03\x04" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, 0, full, full, len(name), 0) + name.encode() + body
    first, end = len(out), len(out) + len(central)
    out += central + b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 2, 2, len(central), first)
    out += b"PK\x06\x07" + struct.pack("<IQI", 0, end, 1) + b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, full, full, 0)
    reader = warc.ZipReader.over(out)
    assert reader.read(warc.DATA, 3, 5) == b"xxxxx" and reader.read(warc.INDEX) == b"y" * 10


def test_zip_reader_needs_only_ranges():
    writer = warc.ArchiveWriter()
    for i in range(50):
        writer.add(warc.record(i, "u", b"x" * 10_000, warc.digest32(b"x" * 10_000), None), n=i)
    data, asked = writer.close(), []
    reader = warc.ZipReader(len(data), lambda at, n: asked.append(n) or data[at : at + n])
    line = json.loads(reader.read(warc.INDEX).splitlines()[30])
    asked.clear()
    assert b"x" * 10_000 in gzip.decompress(reader.read(warc.DATA, line["offset"], line["length"])) and sum(asked) <= line["length"] + 30
    with pytest.raises(ValueError):
        warc.ZipReader.over(b"no archive")
    with pytest.raises(ValueError):
        reader.read(warc.DATA, 0, 10**9)


def test_cuckoo_filter():
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(5000)]
    a, b = linededup.halves(keys)
    made = linededup.CuckooFilter.build(a[:4000], b[:4000])
    assert made.contains(a[:4000], b[:4000]).all() and made.contains(a[4000:], b[4000:]).mean() < 0.01
    made.delete(a[:2000], b[:2000])
    assert made.contains(a[2000:4000], b[2000:4000]).all() and made.contains(a[:2000], b[:2000]).mean() < 0.02


def test_line_store_is_reversible(spark):
    common, rare = "This line stands in many of the documents here!", "y" * 40
    docs = table(spark, [f" {common.upper()}\nown {i}\n{rare if i < 4 else ''}" for i in range(6)] + ODD)
    store = linededup.LineStore(spark).insert(docs)
    out = {r.doc_id: r for r in store.dedup(docs).collect()}
    assert [out[i].n_dropped for i in range(6)] == [1] * 5 + [0] and out[0].text == f"own 0\n{rare}" and out[7].text is None and out[6].n_lines == 1
    fewer = store.delete(spark.createDataFrame([(5,), (4,)], "doc_id bigint"))
    assert fewer.dedup(docs).agg(F.sum("n_dropped")).first()[0] == 0
    again = {r.doc_id: r.n_dropped for r in fewer.insert(docs.where("doc_id in (4, 5)")).dedup(docs).collect()}
    assert [again[i] for i in range(6)] == [1] * 5 + [0]
    assert linededup.LineStore(spark).insert(docs.limit(0)).dedup(docs.limit(0), digest=True).count() == 0


def edits(rng, text, n):
    chars = list(text)
    for _ in range(n):
        i = rng.randrange(len(chars))
        chars[i : i + 1] = rng.choice([[], ["q"], [chars[i], "z"]])
    return "".join(chars)


def test_decontamination(spark):
    rng = random.Random(2)
    items = sentences(rng, 12, 25)
    texts = sentences(rng, 20, 50) + ODD
    for i, item in enumerate(items):
        texts.append(f"before {edits(rng, decontam.normalise(item), i)} after".upper())
    df, bench = table(spark, texts), spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(50, None), (51, "")], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id): r.distance for r in decontam.matches(df, bench).collect()}

    def least(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        return min(row)

    short = [(i, decontam.normalise(t)) for i, t in enumerate(texts) if len(t or "") < 5000]
    for n, item in enumerate(map(decontam.normalise, items)):
        for i, doc in short[-12:] + short[:3]:
            distance = least(item, f" {doc} ")
            assert found.get((i, n)) == (distance if distance <= int(0.1 * len(item)) else None)
    clean = {r.doc_id for r in decontam.keep_clean(df, bench).collect()}
    assert clean == set(range(len(texts))) - {d for d, _ in found} and decontam.keep_clean(df, bench).columns == df.columns


def test_short_and_unnamed_items(spark):
    rng = random.Random(17)
    items = ["what is the capital of peru", "largest planet", *sentences(rng, 6, 5), "art"]
    texts = sentences(rng, 8, 40)
    texts += [f"so {edits(rng, item, rng.randrange(4))} then" for item in items for _ in range(12)]
    texts += ["was what is the capitol of peru asked", "the largest planets are", "enlargest planet", "smart part", "our art"]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    expected = {}
    for d, text in enumerate(texts):
        w = decontam.normalise(text).split()
        for n, item in enumerate(map(decontam.normalise, items)):
            some = (" ".join(w[a:b]) for a in range(len(w)) for b in range(a + 1, min(len(w), a + 10) + 1))
            least = min((distance(item, x) for x in some if abs(len(x) - len(item)) <= len(item) // 10), default=99)
            if least <= len(item) // 10:
                expected[d, n] = least
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    assert {(r.doc_id, r.item_id): r.distance for r in decontam.matches(table(spark, texts), bench).collect()} == expected
    unnamed = bench.select(F.lit(None).cast("bigint").alias("item_id"), "text")
    assert {r.doc_id for r in decontam.keep_clean(table(spark, texts), unnamed).collect()} == set(range(len(texts))) - {d for d, _ in expected}


def brute_components(texts, width, percent):
    sets = {i: set(shingles(t, width).tolist()) for i, t in enumerate(texts)}
    root = {i: i for i in sets}

    def top(x):
        return x if root[x] == x else top(root[x])

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


def near_copies(rng, n):
    texts = []
    for base in sentences(rng, 12, 80):
        for _ in range(n):
            words = base.split()
            for _ in range(rng.randrange(6)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    return texts + texts[:10] + ODD


@pytest.mark.parametrize("task_edges", [50_000, 0])
def test_near_dedup(spark, monkeypatch, task_edges):
    monkeypatch.setattr(components, "TASK_EDGES", task_edges)
    monkeypatch.setattr(components, "HUB_SIZE", 4)
    texts = near_copies(random.Random(4), 12)
    expected = brute_components(texts, 2, 80)
    rows = neardup.components(table(spark, texts), 2, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert neardup.components(table(spark, [])).count() == 0


def test_sketch_merges_and_estimates():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    one, two, both = neardup.registers([x[:2000], x[1000:], x])
    assert (neardup.merge(one, two) == both).all()
    assert abs((one == two).mean() - 1 / 3) < 0.1
    near, far = neardup.registers([x[:950], x[50:1000]]), neardup.registers([x[:600], x[400:1000]])
    sizes = np.array([950.0]), np.array([600.0])
    assert neardup.plausible(near[:1], near[1:], sizes[0], sizes[0], 0.8)[0] and not neardup.plausible(far[:1], far[1:], sizes[1], sizes[1], 0.8)[0]


def test_few_linked_pairs_are_lost():
    assert (1 - 0.8**neardup.BAND_REGISTERS) ** neardup.BANDS < 2e-5
    n = neardup.BANDS * neardup.BAND_REGISTERS
    one = np.full((3, n), 1000, "<u2")
    two = one.copy()
    for row, z in zip(two, (0, 4.8, 8)):  # fewer equal registers than expected at similarity 0.8, by so many standard deviations
        differ = round(0.2 * n + z * (0.16 * n) ** 0.5)
        row[:differ] += np.resize(np.array([1, -1]), differ).astype("<u2")
    size = np.full(3, 500.0)
    assert neardup.plausible(one, two, size, size, 0.8).tolist() == [True, True, False]


def test_compact_windows_against_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(200):
        n, t = int(rng.integers(1, 90)), int(rng.integers(1, 20))
        v = rng.integers(0, [4, 10**9][rng.integers(2)], n).astype(np.uint64)
        expected = []
        for c in range(n):
            l = next((i + 1 for i in range(c - 1, -1, -1) if v[i] <= v[c]), 0)
            r = next((i - 1 for i in range(c + 1, n) if v[i] < v[c]), n - 1)
            if r - l + 1 >= t:
                expected.append((l, c, r))
        assert list(zip(*(x.tolist() for x in passages.compact_windows(v, t)))) == expected


def test_passages(spark):
    rng = random.Random(7)
    shared, texts = sentences(rng, 3, 70), sentences(rng, 30, 120)
    for i in range(12):
        texts[i] = f"{texts[i]} {shared[i % 3]} {sentences(rng, 1, 30)[0]}"
    texts += [texts[20], *ODD[:-2]]
    rows = {r.doc_id: r for r in passages.repeats(table(spark, texts)).collect()}
    assert set(rows) == {*range(12), 20, 30}
    for i in range(12):
        assert rows[i].class_id == i % 3 and any(s.start <= 120 and s.end >= 190 for s in rows[i].spans)
    assert (rows[30].class_id, rows[30].repeated_words, rows[30].n_links) == (20, 120, 1)
    assert passages.repeats(table(spark, [])).count() == 0


def planted(rng, lines, width):
    """Two documents that hold each of some lines singly and then all of them as one passage."""
    shared = sentences(rng, lines, width)
    texts = []
    for _ in range(2):
        loose = [x for line in rng.sample(shared, lines) for x in (line, *sentences(rng, 1, 30))]
        texts.append(" ".join([*loose, *shared, *sentences(rng, 1, 60)]))
    return texts


def meeting(texts):
    one, two = (passages.cells(passages.text_tokens(x)[1])[0] for x in texts)
    return len(np.intersect1d(one, two)) > 0


def test_passages_of_lines_that_stand_earlier():
    rng = random.Random(8)
    assert all(meeting(planted(rng, 5, 12)) for _ in range(400))


def test_passages_that_one_document_holds_twice(spark):
    rng = random.Random(10)
    texts = []
    for passage in sentences(rng, 6, 60):
        a, b, c, d, e = sentences(rng, 5, 40)
        texts += [f"{a} {passage} {b}", f"{c} {passage} {d} {passage} {e}"]
    rows = {r.doc_id: r for r in passages.repeats(table(spark, texts)).collect()}
    for i in range(0, 12, 2):
        for doc, starts in ((i, [40]), (i + 1, [40, 140])):
            assert all(any(s.start <= x and s.end >= x + 60 for s in rows[doc].spans) for x in starts)


def repeated_words(texts, n):
    """For each document its words that lie in exact repeats of n words with an unequal one."""
    held, split = defaultdict(set), [tuple(x.split()) for x in texts]
    for w in split:
        for i in range(len(w) - n + 1):
            held[w[i : i + n]].add(w)
    return [{j for i in range(len(w) - n + 1) if len(held[w[i : i + n]]) > 1 for j in range(i, i + n)} for w in split]


def test_every_exact_repeat_is_in_spans(spark):
    rng = random.Random(13)
    (linked,), (line,), texts = sentences(rng, 1, 60), sentences(rng, 1, 45), []
    for own in sentences(rng, 40, 8):  # one component by a passage; a line of all, too short for one, is most of what two of them share besides
        texts += [" ".join([*sentences(rng, 1, 30), linked, *sentences(rng, 1, 30), line, own, *sentences(rng, 1, 40)]) for _ in range(2)]
    rows = {r.doc_id: r.spans for r in passages.repeats(table(spark, texts)).collect()}
    expected = repeated_words(texts, passages.LEAST_WORDS)
    lost = [len(words - {j for s in rows.get(i, ()) for j in range(s.start, s.end)}) for i, words in enumerate(expected)]
    assert sum(map(len, expected)) > 1000 and sum(lost) == 0, (sum(lost), sum(map(len, expected)))


def test_edited_passages_meet():
    rng, t = random.Random(14), passages.LEAST_WORDS - passages.WIDTH + 1
    similar = missed = 0
    for _ in range(2500):
        base = sentences(rng, 1, rng.randrange(51, 56))[0].split()
        edited = base.copy()
        edited[rng.randrange(len(base))] = "edited"
        one, two = ({*shingles(" ".join(x), passages.WIDTH).tolist()} for x in (base, edited))
        if len(one & two) >= passages.SIMILARITY * len(one | two):  # by brute force
            texts = [" ".join([*sentences(rng, 1, 40), *x, *sentences(rng, 1, 40)]) for x in (base, edited)]
            similar, missed = similar + 1, missed + (not meeting(texts))
    assert similar > 2000 and missed <= 2, (missed, similar)


@pytest.mark.parametrize("old, new", [(0, 12), (12, 0), (7, 7), (0, 14)])
def test_passages_with_a_wide_gap_are_linked(spark, old, new):
    """Halves of 49 words, each too short alone, on either side of words that only one has or that differ; few tokens beside them are alike too."""
    rng = random.Random(31 + new)
    a, b, c, d, one, two = sentences(rng, 6, 49)
    gone, come, near = sentences(rng, 3, 14)
    stray = " ".join(near.split()[:6])
    x, y = f"{one} {' '.join(gone.split()[:old])} {two}", f"{one} {' '.join(come.split()[:new])} {two}"
    sets = [{*shingles(v, passages.WIDTH).tolist()} for v in (x, y)]
    assert len(sets[0] & sets[1]) >= passages.SIMILARITY * len(sets[0] | sets[1])
    texts = [f"{a} {x} {' '.join(c.split()[:6])} {stray} {c}", f"{b} {y} {' '.join(d.split()[:6])} {stray} {d}"]
    held = [passages.text_tokens(v)[1] for v in texts]
    for i, j in ((0, 1), (1, 0)):
        (a0, a1, b0, b1, similarity), *_ = passages.align(held[i], held[j], 46)
        assert similarity >= passages.SIMILARITY and a1 - a0 >= 93 and b1 - b0 >= 93
    if old == 0 and new == 12:
        assert {r.doc_id: r.class_id for r in passages.repeats(table(spark, texts)).collect()} == {0: 0, 1: 0}


def test_a_common_line_that_is_too_short_leads_to_no_alignment(monkeypatch):
    """Members of a bucket that have a line of 45 words in common, and no passage, are neither aligned nor put out; those of a passage are."""
    rng, aligned, t = random.Random(40), [], passages.LEAST_WORDS - passages.WIDTH + 1
    line, passage = sentences(rng, 1, 45)[0], sentences(rng, 1, 10)[0]
    rows = []
    for i, (a, b) in enumerate(zip(sentences(rng, 40, 60), sentences(rng, 40, 60))):
        tokens = passages.text_tokens(f"{a} {line} {passage if i < 2 else ''} {b}")[1]
        place = 65 << 8
        rows.append([{"bucket": 0, "i": 0, "j": 0}, 0, i, i, True, place, tokens[passages._begin(place, t) : 65 + passages.SEED + t].tobytes()])
    block = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["block", "own", "id", "comp", "bare", "place", "around"])
    align = passages.align
    monkeypatch.setattr(passages, "align", lambda a, b, t: aligned.append(1) or align(a, b, t))
    out = [pair for x in passages._sift(t)(iter([block])) for pair in zip(x.column("a").to_pylist(), x.column("b").to_pylist())]
    assert set(out) == {(0, 1)} and len(aligned) <= 2


def test_texts_that_may_share_are_all_that_share():
    """No pair in which either direction aligns a passage is passed over, tokens that repeat included."""
    rng, found, passed = np.random.default_rng(41), 0, 0
    for _ in range(1500):
        kinds = int(rng.choice([1, 2, 5, 30, 10**6]))
        x = rng.integers(1, kinds + 1, int(rng.integers(20, 160))).astype(np.uint64)
        y = x.copy()
        for _ in range(int(rng.integers(0, 9))):
            i = int(rng.integers(0, len(y) + 1))
            y = np.concatenate([y[:i], rng.integers(1, kinds + 2, int(rng.integers(0, 9))).astype(np.uint64), y[i + int(rng.integers(0, 9)) :]])
        shared = bool(passages.align_both(x, y, 46))
        may = passages.Sought(x).may_share(y, 46)
        assert may or not shared
        found, passed = found + shared, passed + (not may)
    assert found > 300 and passed > 300


def test_blocks_of_active_rows(spark):
    """Every two rows of a bucket of which one is active meet in one block; idle ones are dealt for the active ones alone."""
    rows = [(b, i, i % 10 == 0 or b == 2) for b, n in ((1, 100), (2, 20), (3, 1)) for i in range(n)]
    dealt = components.bucket_blocks(spark.createDataFrame(rows, "bucket bigint, id bigint, active boolean"), 10, "active").collect()
    blocks = defaultdict(list)
    for r in dealt:
        blocks[tuple(r.block)].append(r)
    met = Counter((k[0], min(x.id, y.id), max(x.id, y.id)) for k, rs in blocks.items() for x in rs for y in rs if x.id < y.id and (x.own != y.own or k[1] == k[2]))
    expected = {(b, x, y) for b, x, p in rows for c, y, q in rows if b == c and x < y and (p or q)}
    assert expected <= set(met) and all(met[x] == 1 for x in expected) and len(dealt) < 300


def test_cells_against_brute_force():
    """Every sequence lies in the one cell of its signature: the least token of each function and how far they are apart."""
    rng = np.random.default_rng(9)
    for kinds in (1, 3, 20, 10**9):
        for _ in range(20):
            tokens = rng.integers(1, kinds + 1, 200).astype(np.uint64)
            tokens[rng.integers(0, 200, rng.integers(0, 6))] = 0
            t = int(rng.integers(1, 30))
            keys, first, last = passages.cells(tokens, t)
            least = [passages.values(tokens, i) for i in range(passages.HASHES)]
            signature, cell = {}, {int(s): k for k, f, e in zip(keys.tolist(), first, last) for s in range(f, e + 1)}
            assert len(cell) == int((last - first + 1).sum())
            for s in range(len(tokens) - t + 1):
                if (tokens[s : s + t] != 0).all():
                    at = [s + int(np.argmin(v[s : s + t])) for v in least]
                    signature[s] = (*(int(v[x]) for v, x in zip(least, at)), *(x - at[0] for x in at))
            assert set(cell) == set(signature)
            assert len({(cell[s], signature[s]) for s in cell}) == len(set(cell.values())) == len(set(signature.values()))


def test_run_starts_against_brute_force():
    rng = np.random.default_rng(21)
    for _ in range(100):
        t = passages.SEED + int(rng.integers(0, 30))
        held = [(int(rng.integers(0, 300)), int(rng.integers(0, passages.SEED))) for _ in range(rng.integers(1, 40))]
        starts = {s for f, n in held for s in range(f, f + n + 1)}
        expected = [s for s in range(400) if all(x in starts for x in range(s, s + t - passages.SEED + 1))]
        first, last = passages.run_starts(np.array([f << 8 | n for f, n in held]), t)
        assert sorted(s for a, b in zip(first, last) for s in range(a, b + 1)) == expected


def test_word_hashes_of_many_texts(monkeypatch):
    rng = random.Random(22)
    texts = [" ".join(rng.choice(["a", "Ab", "é", "x" * 40, "日本"]) + rng.choice(["", "\n", "\t ", "\x0b"]) for _ in range(rng.randrange(40))) for _ in range(30)] + ["", None, "\n", "y" * 500, "Ab"]
    whole = hash_words(texts)
    monkeypatch.setattr(shingle_module, "HASHED_BYTES", 64)
    parted = hash_words(texts)
    assert whole[0].tolist() == parted[0].tolist() and whole[1].tolist() == parted[1].tolist()
    names = [w for t in texts for w in words(t)]
    assert whole[1].tolist() == np.cumsum([0, *(len(words(t)) for t in texts)]).tolist()
    assert len(set(zip(whole[0].tolist(), names))) == len(set(names)) == len(set(whole[0].tolist()))
    tokens = runs_of(*whole, 3)
    for a, b in zip(whole[1].tolist(), whole[1][1:].tolist()):
        assert (tokens[max(a, b - 2) : b] == 0).all() and (tokens[a : max(a, b - 2)] != 0).all()


def brute_links(texts, t):
    """Pairs of texts, and whether any alignment of the two in either direction holds a passage."""
    held = [passages.text_tokens(x)[1] for x in texts]
    return {(i, j) for i in range(len(texts)) for j in range(i) if passages.align_both(held[i], held[j], t)}


def test_passages_that_only_a_chain_connects(spark):
    """Versions of a passage, each two words from the next: only neighbours are alike."""
    rng = random.Random(24)
    words_, texts = sentences(rng, 1, 60)[0].split(), []
    for i in range(12):
        words_[(i * 7) % 60] = f"v{i}"
        a, b = sentences(rng, 2, 30)
        texts.append(f"{a} {' '.join(words_)} {b}")
    pairs = brute_links(texts, passages.LEAST_WORDS - passages.WIDTH + 1)
    assert 11 <= len(pairs) < 30
    rows = {r.doc_id: r.class_id for r in passages.repeats(table(spark, texts)).collect()}
    assert rows == dict.fromkeys(range(12), 0)


@pytest.mark.parametrize("rounds", [2, 0])
def test_passages_against_all_pairs(spark, monkeypatch, rounds):
    """Classes of all pairs, with exact and edited passages and a line of many; without rounds, blocks alone find them."""
    monkeypatch.setattr(passages, "ROUNDS", rounds)
    monkeypatch.setattr(passages, "BLOCK", 7)
    rng = random.Random(23)
    line, texts = sentences(rng, 1, 30)[0], []
    for passage in sentences(rng, 8, 70):
        for _ in range(4):
            own = passage.split()
            if rng.random() < 0.6:
                own[rng.randrange(70)] = f"new{rng.randrange(10**6)}"
            a, b = sentences(rng, 2, 30)
            texts.append(f"{a} {line if rng.random() < 0.7 else ''} {' '.join(own[rng.randrange(8):])} {b}")
    texts += [f"{x} {line} {y}" for x, y in zip(sentences(rng, 12, 40), sentences(rng, 12, 40))]
    pairs = brute_links(texts, passages.LEAST_WORDS - passages.WIDTH + 1)
    root = list(range(len(texts)))
    for _ in root:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    linked = {i for pair in pairs for i in pair}
    rows = {r.doc_id: r.class_id for r in passages.repeats(table(spark, texts)).collect()}
    assert rows == {i: root[i] for i in linked} and len(linked) >= 30


def test_chat(spark):
    texts = ["</s>[INST] a", "<\\/s> <|turn|>", None, "", "<<SYS>> \\[INST]", "long " * 50_000]
    rows = [(7, i, "assistant" if i % 2 else "user", t, "x") for i, t in enumerate(texts)] + [(8, None, None, None, "x"), (7, 9, "assistant", "end", "y")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, ids string")
    out = {r.conv_id: r for r in chat.digest_conversations(chat.with_probe(turns), CHAT_RANKS, PATTERN).collect()}
    own = [(r or "", t or "") for c, _, r, t, _ in rows if c == 7]
    loss = "".join(t for r, t in own if r == "assistant")
    assert out[7].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
    assert (out[7].n_turns, out[7].loss_chars, out[7].loss_sha256) == (7, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert out[8].n_turns == 1 and out[-1].loss_chars == len("</s>[INST] ok [/INST]")
    assert out[7].formatted_chars == sum(len(chat.escape(r) + chat.escape(t)) + len(chat.TURN + chat.BODY + chat.END) for r, t in own)
    for t in texts:
        escaped = chat.escape(t or "")
        assert chat.unescape(escaped) == (t or "") and not any(c in escaped for c in chat.CONTROL)


CLASHES = "doc_id bigint, text string, score double, _score double, n_lines int, n_dropped int, row string, whole string, key string, keys string, id string, n_chars bigint"
AWKWARD = [(1, "one two three four five six seven"), (1, "one two three four five six seven"), (1, "another text of the same id"), (None, "no id " * 20), (None, None), (2, None), (3, ""), (4, "long " * 100_000)]


def awkward(spark, rows=AWKWARD):
    return spark.createDataFrame([(i, t, 0.5, 0.25, 7, 8, "r", "w", "k", "ks", "x", 3) for i, t in rows], CLASHES)


@pytest.mark.parametrize("rows", [AWKWARD, []], ids=["awkward", "empty"])
def test_awkward_rows(spark, rows):
    """Nulls, repeated rows and ids, empty and long texts, clashing columns and empty tables, in every operator on documents."""
    docs, n = awkward(spark, rows), len(rows)
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 0, 0), (None, 1, 0), (2, None, 0)] if rows else [], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([(1, "one two three four five six seven"), (1, "one two three four five six seven"), (None, "another text of the same id"), (2, None), (3, "")] if rows else [], "item_id bigint, text string")
    assert sharding.shard_documents(docs).count() == quality.digest_scores(docs, labels).count() == bpe.digest_documents(docs, RANKS, PATTERN).count() == n
    kept = quality.keep_good(docs, quality.train(docs, labels))
    assert kept.columns == docs.columns and {r._score for r in kept.collect()} <= {0.25}
    lines = linededup.LineStore(spark).insert(docs).dedup(docs)
    assert lines.columns == [*docs.columns, "n_lines_", "n_dropped_"] and sorted(map(str, ((r.n_lines, r.n_dropped_, r.text) for r in lines.collect()))) == sorted(map(str, ((7, 0, t) for _, t in rows)))
    found = {(r.doc_id, r.item_id, r.distance) for r in decontam.matches(docs, items).collect()}
    assert found == ({(1, 1, 0)} if rows else set())
    clean = decontam.keep_clean(docs, items)
    assert clean.columns == docs.columns and clean.count() == max(0, n - 3)
    near = neardup.components(docs, 2, 80).collect()
    assert len(near) == n and all(r.component_id == r.doc_id and r.kept for r in near)
    assert neardup.keep_one(docs).columns == docs.columns and neardup.keep_one(docs).count() == n
    assert passages.repeats(docs).count() == 0
    assert all(r.decodes for r in bpe.encode_checked(docs, RANKS, PATTERN).collect())


def test_awkward_tables_of_other_shapes(spark):
    pages = spark.createDataFrame([(1, "u", "<p>", "x"), (1, "u", "<p>", "x"), (None, None, None, "y"), (None, None, "<p>", "y")], "page_id bigint, url string, html string, payload_digest string")
    rows = [(r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()]
    assert sorted(map(str, rows)) == ["(1, 'response', None)", "(1, 'response', None)", "(None, 'response', None)", "(None, 'revisit', 1)"]
    turns = spark.createDataFrame([(None, 1, "user", "b", "x"), (None, 1, "user", "a", "x"), (None, None, None, None, "x"), (5, 1, "user", "same", "x"), (5, 1, "user", "same", "x")], "conv_id bigint, turn bigint, role string, text string, mask string")
    out = {r.conv_id: r for r in chat.digest_conversations(turns, CHAT_RANKS, PATTERN).collect()}
    assert out[None].turns_sha256 == hashlib.sha256(b"\n\nuser\na\nuser\nb\n").hexdigest() and out[5].n_turns == 2 and out[5].loss_chars == 0
    assert chat.digest_conversations(turns.limit(0), CHAT_RANKS, PATTERN).count() == 0
    assert topk.search(spark.createDataFrame([(None, [1.0]), (1, [2.0]), (2, [2.0]), (3, [2.0]), (3, [2.0])], "vec_id bigint, embedding array<float>"), F.col("vec_id") == 1).count() == 2


def test_decontamination_by_passes(spark, monkeypatch):
    rng = random.Random(18)
    items = sentences(rng, 9, 12)
    docs = table(spark, [f"{a} {b}" for a, b in zip(sentences(rng, 30, 20), items * 4)] + ODD)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    results = []
    for chars in (4_000_000, 100):
        monkeypatch.setattr(decontam, "PASS_CHARS", chars)
        results.append((sorted(map(tuple, decontam.matches(docs, bench).collect())), {r.doc_id for r in decontam.keep_clean(docs, bench).collect()}))
    assert results[0] == results[1] and len(results[0][0]) == 30


def test_line_dedup_without_filters(spark, monkeypatch):
    """Filters too large for a broadcast, and several shards: the same lines go."""
    rng = random.Random(19)
    lines = sentences(rng, 40, 8)
    docs = table(spark, ["\n".join(rng.sample(lines, 5)) for _ in range(60)])
    results = []
    for size, keys in ((64 << 20, 200_000), (0, 200_000), (64 << 20, 5)):
        monkeypatch.setattr(linededup, "BROADCAST_BYTES", size)
        monkeypatch.setattr(linededup, "SHARD_KEYS", keys)
        results.append(sorted(map(tuple, linededup.LineStore(spark).insert(docs).dedup(docs, digest=True).collect())))
    assert results[0] == results[1] == results[2] and sum(r[2] for r in results[0]) > 0


def test_quality_fit_against_gradient_descent():
    """The pairwise logistic loss at the fitted weights, against a plain minimiser of the same loss."""
    rng = np.random.default_rng(20)
    x = rng.normal(size=(80, 4))
    y = (x @ [1.0, -2.0, 0.5, 0.0] + rng.normal(size=80) > 0).astype(float)
    model = quality.fit(x, y, seed=3)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-6), -8, 8)
    pick = np.random.default_rng(3)
    better, worse = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    n = quality.PAIRS_EACH * min(len(better), len(worse))
    pairs = z[pick.choice(better, n)] - z[pick.choice(worse, n)]

    w = np.zeros(4)
    for _ in range(20_000):
        w -= 1e-3 * (-(pairs * (1 / (1 + np.exp(pairs @ w)))[:, None]).sum(0) + w)
    assert np.allclose(w, model.weights, atol=1e-3)


def test_components_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "TASK_EDGES", 0)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 99), (200, 200)]
    out = components.contract(Scratch(spark, "t"), spark.createDataFrame(edges, "u bigint, v bigint"), "x").collect()
    assert {r.node: r.root for r in out} == {**{i: 0 for i in range(41)}, 99: 99, 100: 99, 101: 99}
