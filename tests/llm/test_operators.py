"""Each operator against a brute-force version, an exact round trip or held-out accuracy, on small tables with every odd case."""

import collections
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F


from causeway.llm import arrays as A

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text, lower=False):
    data = (text or "").encode()
    if lower:
        data = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    return WORD.findall(data)


def make_docs(spark, texts, extra=False):
    rows = [(k, t, ("en", "fr", None)[k % 3], f"s{k % 2}", len(t or "")) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"n_words": F.lit(1), "score": F.lit("x"), "grp": F.lit(2), "node": F.lit(3)}) if extra else df


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)]
    base = [r.choice(vocabulary) for _ in range(90)]
    out = [None, "", "  \t\n", "one", "One", "one two", "a b c", "A b  c", "x" * 3000, "é è ê", "z\x0bq\x0cr"]
    passage = [r.choice(vocabulary) for _ in range(50)]
    for k in range(n):
        kind = k % 5
        t = [r.choice(vocabulary) + str(r.randrange(30)) for _ in range(r.randrange(1, 80))]
        if kind == 0:  # near copies
            t = list(base)
            for _ in range(r.randrange(4)):
                t[r.randrange(len(t))] = f"e{r.randrange(5)}"
        if kind == 1:
            t = t[:10] + passage + t[10:]
        if kind == 2:
            t = t + t[:40] + t
        out.append(" ".join(t))
    return out + out[-6:] + [" ".join(base)] * 5 + [" ".join(r.choice(vocabulary) for _ in range(4000))]


# arrays


def test_words_match_the_pattern():
    texts = corpus()
    data, offsets = A.text_bytes(pa.chunked_array([pa.array(texts, pa.string())]))
    begins, ends, first = A.word_bounds(data, offsets)
    found = [[bytes(data[b:e]) for b, e in zip(begins[s:t], ends[s:t])] for s, t in zip(first[:-1], first[1:])]
    assert found == [words(t) for t in texts]
    h = A.word_hashes(data, begins, ends)
    by = collections.defaultdict(set)
    for w, x in zip((w for f in found for w in f), h.tolist()):
        by[w].add(x)
    assert all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)


@pytest.mark.parametrize("k", [1, 2, 3, 18, 35])
def test_run_hashes_depend_on_the_run_alone(k):
    w = A.mix(np.array([x % 7 for x in range(60)], np.uint64))
    h = A.run_hashes(w, k)
    assert len(h) == 61 - k and all((h[i] == h[j]) == (i % 7 == j % 7) for i in range(len(h)) for j in range(len(h)))


# 1


def test_media_round_trip(spark, tmp_path):
    from causeway.llm import media

    texts = corpus()
    at, rows = media.store(make_docs(spark, texts, True), f"file://{tmp_path}/shards", shard_bytes=4096)
    got = {r.doc_id: r for r in media.features(media.fill_metadata(rows, at), at).collect()}
    by_text = {}
    for k, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.width, r.height, r.bit_depth) == (576, len(payload) // 576, 8)
        assert by_text.setdefault(payload, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
        with open(f"{tmp_path}/shards/{r.shard}", "rb") as f:
            f.seek(r.media_offset)
            assert hashlib.sha256(f.read(r.media_bytes)).hexdigest() == r.media_sha256
    import tarfile

    for shard in {r.shard for r in got.values()}:
        with tarfile.open(f"{tmp_path}/shards/{shard}") as tar:
            for m in tar.getmembers():
                assert hashlib.sha256(tar.extractfile(m).read()).hexdigest() == m.name.removesuffix(".png")
    assert media.media_columns(make_docs(spark, []).limit(0)).count() == 0


def test_png_is_checked():
    from causeway.llm import media

    png = media.to_png(bytes(576))
    assert media.from_png(png) == bytes(576)
    with pytest.raises(ValueError):
        media.png_header(b"no" * 20)
    with pytest.raises(ValueError):
        media.from_png(png[:50] + b"?" + png[51:])


# 2


def records(spark, rows):
    schema = "record_id long, kind string, url string, time long, etag string, last_modified string, digest string, headers map<string,string>, extra string"
    return spark.createDataFrame([(*r, "e") for r in rows], schema)


def test_revisits(spark):
    from causeway.llm.warc import resolve_revisits

    r = random.Random(5)
    rows = []
    for k in range(400):
        url = r.choice(["http://a.com/x", "https://www.A.com/x/#f", "http://a.com/x?utm_source=q", "http://b.org/?b=2&a=1", "http://b.org/?a=1&b=2", "http://hot/"] + ["http://hot/"] * 6 + [None])
        kind = r.choice(["response", "revisit"])
        rows.append((k, kind, url, r.choice([None, *range(60)]), r.choice([None, '"1"', 'W/"1"', '"2"']), r.choice([None, "m1", "m2"]), r.choice([None, "d1", "d2"]), r.choice([None, {"Date": str(k), "Content-Length": "9", "X-A": "b"}])))
    canon = {"http://a.com/x": "a.com/x", "https://www.A.com/x/#f": "a.com/x", "http://a.com/x?utm_source=q": "a.com/x", "http://b.org/?b=2&a=1": "b.org?a=1&b=2", "http://b.org/?a=1&b=2": "b.org?a=1&b=2", "http://hot/": "hot", None: None}
    alone = resolve_revisits(records(spark, rows)).collect()  # in one span
    got = {x.record_id: x for x in resolve_revisits(records(spark, rows), spans=8).collect()}
    assert got == {x.record_id: x for x in alone}
    assert set(got) == {x[0] for x in rows if x[1] == "revisit"}
    for x in rows:
        if x[1] != "revisit":
            continue
        full = [y for y in rows if y[1] == "response" and canon[y[2]] == canon[x[2]] is not None and None not in (x[3], y[3]) and y[3] < x[3]]
        y = max(full, key=lambda y: (y[3], y[0]), default=None)
        outcome = "no_response"
        if y:
            strip = lambda t: t and t.removeprefix("W/")
            pairs = [(x[6], y[6]), (strip(x[4]), strip(y[4])), (x[5], y[5])]
            pairs = [p for p in pairs if None not in p]
            outcome = "unverified" if not pairs else "resolved" if pairs[0][0] == pairs[0][1] else "mismatch"
        g = got[x[0]]
        assert (g.outcome, g.canonical_url) == (outcome, canon[x[2]]), (x, y, g)
        if outcome in ("resolved", "unverified"):
            merged = {k.lower(): v for k, v in (y[7] or {}).items()} | {k.lower(): v for k, v in (x[7] or {}).items() if k.lower() != "content-length"}
            assert (g.response_id, g.digest, g.headers) == (y[0], y[6], merged)
        else:
            assert g.response_id is None and g.headers is None
    assert resolve_revisits(records(spark, [])).count() == 0


# 3


def test_licenses(spark):
    from causeway.llm.licenses import KNOWN, scan_licenses

    mit = KNOWN[0][1]
    texts = ["Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(" ", "\n "), mit.replace("sublicense", "sub-license").replace('"', "“"), mit + " and more", None, "", "...", "released under the mit licence", "© 1999 X\nReleased under the MIT License", mit]
    got = {r.doc_id: r.license_id for r in scan_licenses(make_docs(spark, texts, True)).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: None, 3: None, 4: None, 5: None, 6: "MIT", 7: "MIT", 8: "MIT"}
    own = spark.createDataFrame([("B", "Some Text"), ("A", "some text!"), ("E", "  ")], "license_id string, text string")
    assert [r.license_id for r in scan_licenses(make_docs(spark, ["SOME  text"]), own).collect()] == ["A"]
    heads = ["Copyright (c) 2020 Jane Q. Public. ", "Copyright 1999, 2001 by the Authors, all rights reserved\n", "(c) 2011 Foo Inc. "]
    for head in heads:  # on the licence's own line, too
        one = {r.doc_id: r.license_id for r in scan_licenses(make_docs(spark, [head + t.replace("license", "licence") for _, t in KNOWN])).collect()}
        assert one == {k: i for k, (i, _) in enumerate(KNOWN)}, head
    plan = scan_licenses(make_docs(spark, texts))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_whole_licences_by_digest(spark, tmp_path):
    from causeway.llm.licenses import DIGESTS
    from causeway.llm.queries import ORACLES, op3_license_scan

    folder = "/usr/share/common-licenses"
    names = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}
    if not os.path.isdir(folder):
        pytest.skip("the licences are not here")
    texts = []
    for name in names.values():
        with open(f"{folder}/{name}", encoding="utf-8") as f:
            texts.append(f.read())
    make_docs(spark, texts + [t.upper().replace("  ", "\t") for t in texts] + ["no licence", None]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.license_id for r in op3_license_scan(spark, str(tmp_path)).collect()}
    assert set(names) <= set(DIGESTS) and got == dict(enumerate([*names, *names, None, None]))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert {r[0]: r[2] for r in duck.execute(ORACLES["op3_license_scan"]).fetchall()} == got


# 4


def components_by_force(texts, n, percent):
    sets = []
    for t in texts:
        w = words(t, True)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    top = list(range(len(sets)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return {k: (len(s), root(k)) for k, s in enumerate(sets)}


@pytest.mark.parametrize(("n", "percent", "cells"), [(3, 90, 8_000_000), (5, 80, 8_000_000), (2, 80, 8_000_000), (1, 60, 900), (3, 90, 700), (3, 100, 8_000_000)])
def test_jaccard_components(spark, n, percent, cells):
    from causeway.llm.ngram_join import jaccard_components

    texts = corpus(3, 120)
    got = jaccard_components(make_docs(spark, texts, True), n, percent, cells).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components_by_force(texts, n, percent) and len(got) == len(texts)


def test_jaccard_odd_ids(spark):
    from causeway.llm.ngram_join import jaccard_components

    rows = [(None, "a b c d"), (5, "a b c d"), (5, "q r s t"), (3, "A B C D"), (None, None)]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted([(None, 2, None), (5, 2, 3), (5, 2, 5), (3, 2, 3), (None, 0, None)], key=str)
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_row_of_each_near_copy_stays(spark):
    from causeway.llm.ngram_join import without_near_copies

    long, near = " ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(59))
    rows = [(None, long), (None, long), (7, long), (5, near), (5, near), (5, "q r s t u v"), (9, "q R s t u v"), (8, None), (8, None), (3, ""), (11, "only one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"text_hash": F.lit(1), "r": F.lit("r"), "node": F.map_from_arrays(F.array(F.lit(1)), F.array(F.lit(2)))})
    got = without_near_copies(df)
    assert got.schema.simpleString() == df.schema.simpleString()
    assert sorted(((x.doc_id, x.text) for x in got.collect()), key=str) == sorted([(None, long), (None, long), (5, near), (5, "q r s t u v"), (8, None), (8, None), (3, ""), (11, "only one")], key=str)
    assert without_near_copies(df.limit(0)).count() == 0


def test_bounds_lose_no_pair():
    from causeway.llm import ngram_join as j

    r = random.Random(8)
    for trial in range(20):
        percent, sets = (80, 90, 60)[trial % 3], []
        bases = [r.sample(range(5000), 200) for _ in range(3)]
        for _ in range(30):  # all share some n-grams, few are similar
            s = set(range(5000, 5020)) | set(r.choice(bases)[: r.choice([150, 200])])
            for _ in range(r.randrange(40)):
                s.discard(r.choice(sorted(s)))
            sets.append(sorted(s))
        grams = A.mix(np.concatenate(sets).astype(np.uint64))
        sizes, nodes = np.array([len(s) for s in sets]), np.arange(1, 31)
        level = np.bincount(np.unique(grams, return_inverse=True)[1])[np.unique(grams, return_inverse=True)[1]] > 1
        halves = [j.close(e, percent, tight=True) for e in np.array_split(j.entries(grams, sizes, nodes, level.astype(np.uint8), percent), 2)]  # two blocks of rows
        found, links = j.close(np.concatenate([h[0] for h in halves]), percent)
        top = {n: n for n in range(31)}

        def root(x):
            return x if top[x] == x else root(top[x])

        for a, b in np.concatenate([links, *(h[1] for h in halves)]).tolist():
            top[max(root(a), root(b))] = min(root(a), root(b))
        for a in range(30):
            for b in range(a):
                both = len(set(sets[a]) & set(sets[b]))
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    assert root(a + 1) == root(b + 1)
        assert percent < 80 or len({root(k) for k in range(1, 31)}) > 1  # the bound is good for something


def test_linked_rows_by_force():
    from causeway.llm.ngram_join import linked_rows

    r = random.Random(2)
    for trial in range(60):
        base = r.sample(range(1000), 30)
        sets = []
        for _ in range(r.randrange(1, 30)):
            s = set(base if trial % 3 else r.sample(range(60), 30))
            for _ in range(r.randrange(4)):
                s.discard(r.choice(sorted(s)))
                s.add(r.randrange(1000, 1010))
            sets.append(s)
        grams = np.concatenate([np.array(sorted(s), np.uint64) for s in sets])
        got, _ = linked_rows(grams, np.array([len(s) for s in sets]), 90, cells=(50, 4_000_000)[trial % 2])
        top = list(range(len(sets)))
        for _ in sets:
            for a in range(len(sets)):
                for b in range(len(sets)):
                    if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                        top[a] = top[b] = min(top[a], top[b])
        assert got.tolist() == top


def test_components_of_a_chain_and_a_star(spark):
    from causeway.llm.components import components

    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)}


# 5 and 7


@pytest.fixture(scope="module")
def tokenizers():
    return pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")


ODD = ["don't stop'n 's x", "a  b", "x\r\ny", "tab\there", "A!!B?? c%%%", "été.Ça×2÷3", "é .́ İ Σς", "<|endoftext|> a<|startoftext|>", "12.5% (x-y)_z", " lead", "trail ", "\n\n", "\0 a", "日本語。テスト", "a b", "'.", "x\n'll y"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_library(tokenizers, name):
    from causeway.llm.tokens import Encoder

    path = tokenizers[1].path(name)
    plain = tokenizers[0].Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    texts = corpus() + ODD
    e = Encoder(path, most=200)
    for _ in range(3):
        got = [i.tolist() for k in range(0, len(texts), 7) for i in e.encode(texts[k : k + 7])]
        assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_packing(spark, tokenizers):
    from causeway.llm.packing import pack

    path = tokenizers[1].path("word_bpe_49k.json")
    plain = tokenizers[0].Tokenizer.from_file(path)
    texts = corpus(4, 200)
    rows = pack(make_docs(spark, texts, True).repartition(3), path, 1, 64, with_ids=True).collect()
    windows, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    fills = []
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at and length > 0
            at += length
        fills.append(at)
    assert max(fills) <= 64 and all(f == 64 or f & (f - 1) == 0 for f in fills)
    for k, t in enumerate(texts):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces[k], key=lambda p: p.start):
            part = ids[p.start : p.start + p.length]
            assert p.start == at and p.doc_tokens == len(ids) and p.ids == part.tolist() and p.ids_crc32 == zlib.crc32(part.tobytes())
            at += p.length
        assert at == len(ids)
    assert pack(make_docs(spark, []), path).count() == 0


def test_packing_takes_the_best_level():
    from causeway.llm.packing import Windows

    w = Windows(10)
    r = random.Random(3)
    for _ in range(300):
        n = r.randrange(1, 10)
        cost = {h: sum(c * c for c in _moved(w.count, h, n, 10)) for h in range(10 - n + 1) if h == 0 or w.count[h]}
        assert cost[w.level(n)] == min(cost.values())
        w.put((0, 0, np.zeros(n, np.uint32)))


def _moved(count, level, n, size):
    c = count.tolist()
    c[level] -= level > 0
    if level + n < size:
        c[level + n] += 1
    return c[1:size]


def test_token_files(spark, tokenizers, tmp_path):
    from causeway.llm import token_files as f

    assert f.crc32c(b"123456789") == 0xE3069283
    for n in (0, 1, 3, 5, 1023, 1024, 1025, 2500):
        data = random.Random(n).randbytes(n)
        crc = 0xFFFFFFFF
        for b in data:
            crc ^= b
            for _ in range(8):
                crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
        assert f.crc32c(data) == crc ^ 0xFFFFFFFF and f.unframe(f.frame(data)) == data
    with pytest.raises(ValueError):
        f.unframe(f.frame(b"abc")[:-1] + b"\0")
    path = tokenizers[1].path("byte_bpe_50k.json")
    plain = tokenizers[0].Tokenizer.from_file(path)
    texts = corpus()
    docs = make_docs(spark, texts, True).union(make_docs(spark, ["no id"], True).withColumn("doc_id", F.lit(None).cast("long")))
    at, files = f.write_files(docs.repartition(5), path, 0, f"file://{tmp_path}/t")
    got = sorted(f.read_summary(at, files).collect(), key=lambda r: r.start)
    start = 0
    for doc_id, t, r in zip([None, *range(len(texts))], ["no id", *texts], got, strict=True):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    name = files.orderBy("part").first()["name"]
    whole = list(f.read_records(at, name))
    assert [x[0] for x in f.read_records(at, name, np.array([1, 0]))] == [1, 0] and len(whole) > 1
    with pytest.raises(ValueError):
        f.write_files(docs.withColumn("doc_id", F.lit("a")), path)
    empty = f.write_files(make_docs(spark, []), path)
    assert f.read_summary(*empty).count() == 0


# 6


def test_language(spark):
    from causeway.llm.language import identify

    r = random.Random(1)
    syllables = {"en": ["th", "er", "on", "ing", "sh"], "de": ["sch", "ung", "ei", "pf", "ch"], "fr": ["eau", "ou", "qu", "oi", "ent"], "es": ["ado", "cion", "os", "lla", "ue"], "xx": ["zz", "kk", "pp"]}
    rows = []
    for k in range(400):
        lang = r.choice(sorted(syllables))
        rows.append((k, " ".join("".join(r.choice(syllables[lang]) for _ in range(3)) for _ in range(r.randrange(5, 60))), lang, "s", 1))
    odd = [None, "", "123 !!", "\n", "é"]
    rows += [(1000 + k, t, None, "s", 1) for k, t in enumerate(odd)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit(1), "has_letter": F.lit(5), "letter": F.lit("l"), "h": F.col("doc_id"), "odd": F.struct(F.lit(1).alias("a b-c"))})
    got = {x.doc_id: x for x in identify(df, F.col("doc_id") % 3 != 1, sample=200).collect()}
    assert all((x.has_letter, x.letter, x.h, x.odd[0]) == (5, "l", x.doc_id, 1) for x in got.values())
    held = [x for x in rows if x[0] < 1000 and x[0] % 3 == 1]
    assert sum(got[x[0]].lang_pred == x[2] for x in held) > 0.97 * len(held)
    assert [got[1000 + k].lang_pred for k in range(4)] == ["und"] * 4 and got[1004].lang_pred in syllables
    assert all(0 <= x.score <= 1 for x in got.values()) and got[1000].score == 0
    nothing = identify(df.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [x.lang_pred for x in nothing] == ["und"]
    one = identify(df.where("lang = 'en' or lang is null")).where("doc_id = 1004").first()
    assert one.lang_pred == "en" and identify(df.limit(0)).count() == 0
    hot = df.union(df.where("doc_id = 3").select(*[F.explode(F.sequence(F.lit(1), F.lit(400))).alias("k"), "*"]).drop("k"))
    assert identify(hot, sample=50).where("lang = lang_pred").count() > 700  # one row four hundred times


def test_language_rejects(spark):
    from causeway.llm.language import recognised

    r = random.Random(2)
    syllables = {"en": ["th", "er", "on"], "de": ["sch", "ung", "ei"], "fr": ["eau", "ou", "qu"]}
    rows = [(k, " ".join("".join(r.choice(syllables[v]) for _ in range(3)) for _ in range(30)), v, "s", 1) for k in range(150) for v in [("en", "de", "fr")[k % 3]]]
    rows += [(200, None, "en", "s", 1), (201, "12 34", "en", "s", 1), (None, rows[0][1], None, "s", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("lang_pred", F.lit("mine"))
    got = recognised(df)
    assert got.schema.simpleString() == df.schema.simpleString() and {x.doc_id for x in got.collect()} == {None, *range(150)} and got.where("lang_pred = 'mine'").count() == 151
    assert recognised(df, least=1.1).count() == 0
    nothing = df.withColumn("lang", F.lit(None).cast("string"))  # nothing to learn: what has a letter stays
    assert {x.doc_id for x in recognised(nothing).collect()} == {None, *range(150)}
    assert recognised(df.limit(0)).count() == 0


# 8


@pytest.mark.parametrize("window", [35, 8, 3])
def test_substring_dedup(spark, window):
    from causeway.llm.substring_dedup import remove_repeats

    texts = corpus(7, 80)
    docs = make_docs(spark, texts, True).withColumns({"others": F.struct(F.col("doc_id").alias("a b")), "grp": F.concat(F.lit("g"), "doc_id"), "a b": F.lit(4)})
    out = remove_repeats(docs, window, group_bytes=3000)
    got = {r.doc_id: r for r in out.collect()}
    assert all((r.grp, r.others[0], r["a b"], r.source, r.node) == (f"g{k}", k, 4, f"s{k % 2}", 3) for k, r in got.items())
    assert out.columns == [*docs.drop("n_words").columns, "n_words", "n_removed"]
    split = [words(t) for t in texts]
    count = collections.Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    for k, w in enumerate(split):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g).decode()
        assert (got[k].text, got[k].n_words, got[k].n_removed) == (kept, len(w), sum(gone))
    assert len(got) == len(texts) and remove_repeats(make_docs(spark, [])).count() == 0


def test_substring_dedup_repeated_rows(spark):
    from causeway.llm.substring_dedup import remove_repeats

    text = " ".join(f"w{k}" for k in range(40))
    rows = [(None, text), (None, text), (1, "short one"), (1, "short one")]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text, r.n_removed) for r in got) == [("1", "short one", 0)] * 2 + [("None", "", 40)] * 2


# 9


def test_toxicity(spark):
    from causeway.llm.toxicity import score_toxicity

    r = random.Random(1)
    clean, bad = ["ther", "onin", "sheat", "blent", "ereing", "handed", "tionly"], ["vugrak", "zonkle", "quibzat"]
    rows, labels = [], []
    for k in range(600):
        toxic = k % 5 == 0
        t = ["".join(r.choice(clean) for _ in range(2)) for _ in range(r.randrange(20, 80))]
        for _ in range(max(2, len(t) // 20) if toxic else 0):
            t[r.randrange(len(t))] = r.choice(bad)
        rows.append((k, " ".join(t)))
        labels.append((k, 1, int(toxic)))
    labels += [(700, 1, None), (None, 1, 1)]
    rows += [(900, None), (901, ""), (None, "ther"), (902, "!!!"), (903, "x" * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit("clash"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    got = {x.doc_id: x.score for x in score_toxicity(docs, lab, F.col("doc_id") % 4 != 2).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    held = [k for k in range(600) if k % 4 == 2]
    hit = sum((got[k] >= 0.3) == (k % 5 == 0) for k in held)
    assert hit > 0.95 * len(held)
    assert score_toxicity(docs, lab.limit(0), F.lit(True)).where("score <> 0").count() == 0
    assert score_toxicity(docs.limit(0), lab, F.lit(True)).count() == 0


def kneser_ney_by_force(docs, t):
    """Ratio of a word, by the textbook: docs are (text, class)."""
    pad, c = "\2" * (t.ORDER - 1), [collections.Counter(), collections.Counter()]
    split = lambda x: re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(ch.lower() if len(ch.lower()) == 1 else ch for ch in x or ""))
    cut = lambda w: [(pad + w + "\3")[i : i + t.ORDER] for i in range(len(w) + 1)]
    for text, y in docs:
        for w in set(split(text)):
            c[y].update(cut(w))
    levels = {t.ORDER: c[0] + c[1]}
    for k in range(t.ORDER - 1, 0, -1):
        levels[k] = collections.Counter(g[1:] for g in levels[k + 1])

    def shared(g):
        table = levels[len(g)]
        if len(g) == 1:
            return table[g] / sum(table.values())
        same = [n for x, n in table.items() if x[:-1] == g[:-1]]
        return (max(table[g] - t.DISCOUNT, 0) + t.DISCOUNT * len(same) * shared(g[1:])) / sum(same)

    def chance(g, y):
        same = [n for x, n in c[y].items() if x[:-1] == g[:-1]]
        left = t.DISCOUNT * len(same) + t.STRENGTH
        seen = g in levels[t.ORDER]  # else the shared estimate is the same in both
        return (max(c[y][g] - t.DISCOUNT, 0) + left * (shared(g) if seen else 1)) / (sum(same) + t.STRENGTH)

    known = {}

    def ratio(w):
        if w not in known:
            known[w] = sum(np.log(chance(g, 1)) - np.log(chance(g, 0)) for g in cut(w))
        return known[w]

    def features(text):
        r = [(ratio(w), len(w) + 1) for w in split(text)]
        return sum(x for x, _ in r) / max(1, sum(n for _, n in r)), sum(max(x - t.LEVEL, 0) for x, _ in r) / max(1, len(r)) ** 0.5

    return features


def test_kneser_ney_by_force(spark):
    from causeway.llm import toxicity as t

    r = random.Random(6)
    some, bad = ["Ωmega", "ther", "ÇA", "onin", "日本語", "a1", "İx", "sheat"], ["vugrak", "груб", "k1ll", "壞字"]
    texts = [" ".join(r.choice(some) + r.choice(["", "s", "ing"]) for _ in range(r.randrange(12))) + ("; " + r.choice(bad)) * (k % 4 == 0) for k in range(60)] + [None, "", "...", "new Words 新字 only", "ther " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(60) if k % 5], "doc_id long, toxic int")
    seen = docs.join(labels, "doc_id").select("text", F.col("toxic").alias("kind"))  # all in one fold
    counts = seen.mapInArrow(t._count, "g string, " + ", ".join(f"{c} long" for c in t._COUNTS)).groupBy("g").agg(*(F.sum(c).alias(c) for c in t._COUNTS))
    tables = t.ratio_tables(counts)
    features = kneser_ney_by_force([(texts[k], int(k % 4 == 0)) for k in range(60) if k % 5], t)
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.lit(t.FOLDS).alias("model"))
    for entries in (10**6, 0):  # broadcast, and joined
        got = {x.id: (x.f0, x.f1) for x in t._featured(rows, tables, t._held(tables, entries)).collect()}
        assert len(got) == len(texts) and all(got[k] == pytest.approx(features(x), abs=1e-4) for k, x in enumerate(texts))
    held_back = t._featured(rows.withColumn("model", F.lit(0)), tables, t._held(tables, 10**6)).collect()
    assert all((x.f0, x.f1) == (0, 0) for x in held_back)  # that model has learned nothing


@pytest.mark.parametrize("bad", [["грубый", "дурак"], ["壞字", "惡言"], ["1488x", "666"], ["idiot", "moron"]])
def test_toxic_words_of_any_script(spark, bad):
    from causeway.llm.toxicity import score_toxicity

    r = random.Random(3)
    plain = ["слово", "文字", "1024", "word", "été"]
    rows = [(k, " ".join([r.choice(plain) + r.choice(["", "a", "ка", "語", "7"]) for _ in range(r.randrange(20, 60))] + [r.choice(bad) for _ in range(6 * (k % 6 == 0))])) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 6 == 0)) for k, _ in rows], "doc_id long, toxic int")
    usable = F.col("doc_id") % 4 != 2
    got = {x.doc_id: x.score for x in score_toxicity(docs, labels, usable).collect()}
    assert sum((got[k] >= 0.3) == (k % 6 == 0) for k in range(2, 500, 4)) >= 124
    again = {x.doc_id: x.score for x in score_toxicity(docs, labels, usable, table_entries=0).collect()}
    assert again == pytest.approx(got, abs=1e-4)


# 10


def align_by_force(item, passage):
    h = np.zeros((len(item) + 1, len(passage) + 1), int)
    for i, a in enumerate(item):
        for j, b in enumerate(passage):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a == b else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_alignment_by_force():
    from causeway.llm.decontaminate import align

    r = np.random.default_rng(1)
    for _ in range(50):
        item, passages = r.integers(0, 5, r.integers(1, 12)).astype(np.uint64), r.integers(0, 5, (4, 15)).astype(np.uint64)
        ends = r.integers(1, 16, 4)
        got = align(item, passages, np.arange(15) < ends[:, None])
        assert got.tolist() == [align_by_force(item, p[:e]) for p, e in zip(passages, ends)]


def test_decontamination(spark):
    from causeway.llm.decontaminate import contaminated, without_contaminated

    r = random.Random(9)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(8, 40))) for _ in range(12)] + [None, "too short", items_twice := "alpha beta gamma delta epsilon zeta", items_twice]
    texts, leaks = [None, "", "alpha beta"], set()
    for k in range(3, 80):
        t = [r.choice(vocabulary) for _ in range(r.randrange(5, 200))]
        if k % 4 == 0:
            i = r.randrange(12)
            copy = items[i].upper().replace(" ", ", ").split()
            if k % 8 == 0:  # edited: a word in ten
                for p in range(5, len(copy), 10):
                    copy[p] = "changed"
            p = r.randrange(len(t))
            t[p:p] = copy
            leaks.add((k, i))
        texts.append(" ".join(t))
    texts += [items_twice] * 3
    leaks |= {(80 + k, i) for k in range(3) for i in (14, 15)}
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("score", F.lit("x"))
    docs = make_docs(spark, texts, True)
    got = contaminated(docs, benchmark).collect()
    assert {(x.doc_id, x.item_id) for x in got} == leaks and all(0.5 <= x.score <= 1 for x in got)
    assert {(x.doc_id, x.item_id) for x in contaminated(docs, benchmark, item_bytes=600).collect()} == leaks
    clean = without_contaminated(docs, benchmark)
    assert clean.schema == docs.schema and {x.doc_id for x in clean.collect()} == set(range(len(texts))) - {k for k, _ in leaks}
    assert contaminated(docs, benchmark.limit(0)).count() == 0 and contaminated(docs.limit(0), benchmark).count() == 0


def test_decontamination_by_force(spark):
    from causeway.llm.decontaminate import contaminated

    r = random.Random(4)
    some = [f"w{k}" for k in range(40)]
    items = [[r.choice(some) for _ in range(r.choice([3, 4, 5, 8, 11, 15, 24]))] for _ in range(14)]
    items += [[f"a{k}" for k in range(30)], [f"b{k}" for k in range(11)]]
    texts = [["x"] * 9 + [w if k % 5 != 4 else "changed" for k, w in enumerate(items[14])] + ["y"] * 9, [w if k != 5 else "changed" for k, w in enumerate(items[15])]]
    texts.append([w for k, w in enumerate(items[14]) for w in [w, *["new"] * (k % 3 < 2)]])  # words put in between
    for k in range(150):
        copy = [w for w in items[k % 14] for w in r.choice([[w], [w], [w], [], ["changed"], [w, "new"]])]
        texts.append([r.choice(some) for _ in range(r.randrange(30))] + copy + [r.choice(some) for _ in range(r.randrange(30))])
    benchmark = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    for least in (0.5, 0.7):
        expected = {}
        for d, t in enumerate(texts):
            for i, x in enumerate(items):
                score = align_by_force(x, t)
                if score >= max(2 * least * len(x) - 1e-9, 5):
                    expected[d, i] = score / (2 * len(x))
        got = {(x.doc_id, x.item_id): x.score for x in contaminated(make_docs(spark, [" ".join(t) for t in texts]), benchmark, least=least).collect()}
        assert got == pytest.approx(expected) and {(0, 14), (1, 15)} <= set(got)


@pytest.mark.parametrize("edit", ["changed", "inserted", "dropped"])
def test_decontamination_recall_by_distance_of_edits(spark, edit):
    from causeway.llm.decontaminate import contaminated

    r = random.Random(12)
    items = [[f"i{k}w{j}" if j % 3 else f"c{r.randrange(20)}" for j in range(r.randrange(9, 40))] for k in range(10)]
    texts, apart = [], []
    for k, item in enumerate(items):
        for every in range(3, 11):
            copy = []
            for j, w in enumerate(item):
                hit = j % every == every - 1
                copy += ["new"] if hit and edit == "changed" else [w, "new"] if hit and edit == "inserted" else [] if hit and edit == "dropped" else [w]
            texts.append(["a"] * 5 + copy + [f"c{r.randrange(20)}" for _ in range(8)])
            apart.append((k, every))
    benchmark = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if align_by_force(x, t) >= max(len(x) - 1e-9, 5)}
    got = {(x.doc_id, x.item_id) for x in contaminated(make_docs(spark, [" ".join(t) for t in texts]), benchmark).collect()}
    assert got == want and {(d, k) for d, (k, every) in enumerate(apart) if every >= 4} <= want


def test_decontamination_of_short_items(spark):
    from causeway.llm.decontaminate import contaminated

    items = ["Quux", "grault garply", "", "!!", "我们今天去北京看长城", "ภาษาไทย", "日本 go語"]
    texts = ["a quux, b", "quuxes", "grault, GARPLY.", "grault x garply", "garply grault", "他说我们今天要去北京看长城。", "看北长我今", "เรียนภาษาไทยนะ", "用日本go語を", "日本 x", "grault"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in contaminated(make_docs(spark, texts), benchmark).collect()}
    assert got == {(0, 0), (2, 1), (5, 4), (7, 5), (8, 6)}


def test_repeated_rows_of_many_operators(spark, tokenizers):
    """A third of all rows is one row: each of its copies gets a row, and the same one."""
    from causeway.llm import decontaminate, licenses, media, packing, substring_dedup

    docs = make_docs(spark, [" ".join(f"w{k}" for k in range(50)), "some other text", None])
    docs = docs.union(docs.where("doc_id = 0").select(*[F.explode(F.sequence(F.lit(1), F.lit(40))).alias("k"), "*"]).drop("k")).repartition(4)
    assert media.media_columns(docs).where("doc_id = 0").groupBy("media_sha256", "feature").count().collect()[0]["count"] == 41
    assert licenses.scan_licenses(docs).where("doc_id = 0").count() == 41
    assert substring_dedup.remove_repeats(docs).where("n_removed = 50 and text = ''").count() == 41
    pieces = packing.pack(docs, tokenizers[1].path("word_bpe_49k.json")).where("doc_id = 0").groupBy("doc_tokens").agg(F.sum("length").alias("n")).collect()
    assert len(pieces) == 1 and pieces[0].n == 41 * pieces[0].doc_tokens
    nameless = packing.pack(docs.withColumn("doc_id", F.lit(None).cast("long")), tokenizers[1].path("word_bpe_49k.json"))
    assert nameless.where("doc_id is not null").count() == 0 and nameless.agg(F.sum("length")).first()[0] == packing.pack(docs, tokenizers[1].path("word_bpe_49k.json")).agg(F.sum("length")).first()[0]
    item = spark.createDataFrame([(7, "w3 w4 w5 w6 w7 w8"), (8, "w3 w4 w5 w6 w7 w8")], "item_id long, text string")
    found = decontaminate.contaminated(docs, item).groupBy("doc_id", "item_id", "score").count().collect()  # and tied items
    assert sorted((x.doc_id, x.item_id, x.score, x["count"]) for x in found) == [(0, 7, 1.0, 41), (0, 8, 1.0, 41)]
    assert decontaminate.without_contaminated(docs.withColumn("score", F.lit("s")), item).where("score = 's'").count() == 2


def test_header_names_that_differ_in_case(spark):
    from causeway.llm.warc import resolve_revisits

    old, new = {"Date": "1", "date": "2", "Link": None, "X": "a", "x": None}, {"ETag": "b", "etag": "c", "Y": None}
    rows = [(1, "response", "http://a/", 1, None, None, None, old), (2, "revisit", "http://a/", 2, None, None, None, new), (None, None, None, None, None, None, None, None), (None, "revisit", None, None, None, None, None, None)]
    got = {x.record_id: x for x in resolve_revisits(records(spark, rows)).collect()}
    assert set(got) == {2, None} and got[None].outcome == "no_response" and got[2].outcome == "unverified"
    assert got[2].headers == {"date": "1, 2", "link": None, "x": "a", "etag": "b, c", "y": None}


def test_one_id_of_many_texts_is_many_files(spark, tokenizers, tmp_path):
    from causeway.llm import token_files as f

    path = tokenizers[1].path("byte_bpe_50k.json")
    rows = [(i, t) for i in (None, 5) for t in [None, *(f"{k % 40:03d} text" + " w" * (k % 7) for k in range(200))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    at, files = f.write_files(docs, path, 0, f"file://{tmp_path}/t")
    assert files.count() > 2 and files.agg(F.max("records")).first()[0] < 201  # ranges of one id too
    plain, start = tokenizers[0].Tokenizer.from_file(path), 0
    expected = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1] or ""))
    for (doc_id, t), r in zip(expected, sorted(f.read_summary(at, files).collect(), key=lambda r: r.start), strict=True):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_names_of_odd_characters(spark):
    from causeway.llm import language, ngram_join, substring_dedup

    docs = make_docs(spark, ["some words here " * 9, "other words there " * 9, None], True).withColumns({"a b.`c": F.lit("q"), "x.y": F.lit("r")})
    for out, n in ((substring_dedup.remove_repeats(docs, 3), 3), (language.identify(docs), 3), (language.recognised(docs, least=0.0), 2), (ngram_join.without_near_copies(docs), 3)):
        assert {"a b.`c", "x.y"} <= set(out.columns)
        got = out.select(A.column("a b.`c").alias("q"), A.column("x.y").alias("r")).collect()
        assert [tuple(x) for x in got] == [("q", "r")] * n


@pytest.mark.parametrize("kind, ids", [("long", [None, 4, None]), ("string", [None, "4", "5"]), ("short", [3, None, 4]), ("decimal(10,0)", [3, 4, 4]), ("date", [None, "2020-01-02", "2020-01-01"])])
def test_item_ids_of_any_type(spark, kind, ids):
    from causeway.llm.decontaminate import contaminated, without_contaminated

    text = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, "a b " + text), (None, text), (2, "clean words only here"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(None if i is None else str(i), text) for i in ids] + [(None, None), (None, "")], "item_id string, text string").withColumn("item_id", F.col("item_id").cast(kind))
    for item_bytes in (1 << 20, 150):
        found = contaminated(docs, items, item_bytes=item_bytes)
        assert found.schema["item_id"].dataType == items.schema["item_id"].dataType
        got = sorted(((x.doc_id, x.item_id, x.score) for x in found.collect()), key=str)
        assert got == sorted(((d, i.item_id, 1.0) for d in (1, None) for i in items.where("text like 'w0%'").collect()), key=str)
        assert sorted(x.doc_id for x in without_contaminated(docs, items, item_bytes=item_bytes).collect()) == [2, 3]


# pipeline


def test_pipeline_by_force(spark, tmp_path, tokenizers):
    import corpus_pipeline as c

    texts = corpus(11, 60) + ["123 456"]
    leak = "some item of a benchmark that is long enough to be found"
    texts += [f"before {leak} after"]
    docs = make_docs(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {k: t for k, t in enumerate(texts) if re.search(r"[^\W\d_]", t or "")}
    step, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in c.STAGES:
        before, step = step, c.settled(stage(spark, step, str(tmp_path)), name)
        rows = {r.doc_id: r for r in step.collect()}
        if name != "packing":
            assert step.columns == docs.columns
        if name == "language_id":
            assert set(rows) == set(kept)
        if name == "ngram_jaccard":
            ids = sorted(kept)
            want = {ids[r] for _, r in components_by_force([kept[k] for k in ids], 5, 80).values()}
            assert set(rows) == want
        if name == "substring_dedup":
            split = {r.doc_id: words(r.text) for r in before.collect()}
            count = collections.Counter(tuple(w[i : i + 35]) for w in split.values() for i in range(len(w) - 34))
            want = {}
            for k, w in split.items():
                gone = {i + j for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for j in range(35)}
                if left := b" ".join(x for i, x in enumerate(w) if i not in gone).decode():
                    want[k] = left
            assert {k: r.text for k, r in rows.items()} == want and all(r.n_chars == len(r.text) for r in rows.values())
        if name == "decontamination":
            item = re.findall("[a-z0-9]+", leak)
            held = {r.doc_id for r in before.collect() if align_by_force(item, re.findall("[a-z0-9]+", r.text.lower())) >= len(item)}
            assert {r.doc_id for r in before.collect()} - set(rows) == held == {len(texts) - 1}
        if name == "packing":
            plain = tokenizers[0].Tokenizer.from_file(tokenizers[1].path("word_bpe_49k.json"))
            ids = {r.doc_id: np.array([*plain.encode(r.text, add_special_tokens=False).ids, 1], "<u4") for r in before.collect()}
            pieces = step.collect()
            assert sum(p.length for p in pieces) == sum(map(len, ids.values()))
            assert all(p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes()) and p.doc_tokens == len(ids[p.doc_id]) for p in pieces)
        seen.append(len(rows))
    assert seen[-1] == seen[-2] and c.run(spark, str(tmp_path)).count() > 0


def test_queries_are_registered():
    import __spark_entry__ as e

    found = e.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {k[: k.index("_") + 1] for k in found if k.startswith("op")} and "pipeline" in found
    assert set(e.oracle_sql()) <= set(found)



