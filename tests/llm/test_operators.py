import hashlib
import json
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import bpe, components, decontam, jaccard_join, langid, pii, queries, sharding, token_files, topk, url_filter, warc
from corpusmill.llm.common import Scratch, table

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t", "A.", "é😀 word", "x" * 30_000, "same text here again", "same text here again", "1234 " * 2000, "<|endoftext|> a<|endoftext|>"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 3 else "en", "s") for i, t in enumerate(ODD)] + [(None, "no id at all", "fr", None), (3, "A.", "en", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, component string")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def test_language_id(spark, docs, odd):
    got = queries.op1_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    out = {r.doc_id: r.lang_pred for r in langid.identify(odd, langid.train(docs)).collect()}
    assert out[0] == out[1] == out[2] == out[8] == "und" and out[4] != "und"
    assert {r.lang_pred for r in langid.identify(odd, langid.PPM({})).collect()} == {"und"}
    assert langid.identify(odd.limit(0), langid.train(odd)).count() == 0


def test_code_lengths_are_a_distribution():
    m = langid.PPM({"x": [b"abracadabra"], "y": [b"zzz"]})
    for context in (b"abr", b"zzz", b"qqq"):
        a = np.concatenate([np.frombuffer(context + bytes([b]), np.uint8) for b in range(256)])
        bits = np.array([m.code_lengths(a[i * 4 : i * 4 + 4])[0] for i in range(256)])
        assert np.exp2(-bits).sum(axis=0) == pytest.approx([1, 1], abs=1e-3)


def _groups(rows, k, num):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_join(spark, docs, odd):
    base = [f"w{i}" for i in range(60)]
    chain = [(1000 + j, " ".join(base[: 60 - j] + [f"v{i}" for i in range(j)])) for j in range(0, 12)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + chain + [(2000 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, num in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(df, k, num).collect()}
        assert got == _groups(rows, k, num)
    assert jaccard_join.jaccard_groups(odd.limit(0)).count() == 0
    assert jaccard_join.jaccard_groups(odd).count() == odd.count()


@pytest.mark.parametrize("num", [80, 90])
def test_partenum_shares_a_signature(num):
    r = np.random.default_rng(5)
    scheme = jaccard_join.PartEnum(num)
    for size in (5, 9, 20, 70, 300, 2000):
        for _ in range(30):
            a = np.unique(r.integers(0, 2**63, size, dtype=np.uint64))
            differ = len(a) * (100 - num) // 100
            b = np.unique(a[differ:]) if r.random() < 0.5 else np.unique(np.concatenate([a, r.integers(0, 2**63, differ, dtype=np.uint64)]))
            inter = len(np.intersect1d(a, b))
            if len(a) != inter or len(b) != inter:
                assert 100 * inter >= num * (len(a) + len(b) - inter)
                assert len(np.intersect1d(scheme.signatures(a), scheme.signatures(b)))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (100, 102), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges, Scratch(spark, "t")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}


def _base(t):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(k, s):
        d = re.sub("[^0-9]", "", s)
        if k == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if k == "card":
            return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return k != "phone" or 9 <= len(d) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k, p in patterns.items() for m in re.finditer(p, t or "") if ok(k, m.group())]


def test_pii(spark, docs):
    more = [*ODD[:7], "a@b.c-_x@d.e", "é😀 a@b.co 1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 9807915762804490", "+1 (017) 555-7713 +12 345 67 89 00", "x@y.z" * 200, "1 " * 500, "call (555) 123-4567"]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in pii.digests(df).collect():
        base = _base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b.startswith(k) for b in base) for k in pii.KINDS]
        assert set(base) <= set(r.spans.split(",")) if base else True
    red = {r.doc_id: r.text for r in pii.redaction_stage(df.withColumn("n_chars", F.lit(0).cast("long"))).collect()}
    assert red[10**6 + 13] == "call [PHONE]" and "9807915762804490" not in red[10**6 + 9] and len(red) == len(texts)


def test_pii_scores_a_plain_at_with_a_disguised_dot(spark):
    said = ["Kontakt: joe@example[dot]com heute", "ana.perez@correo (dot) org", "joe@example dot com"]
    df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(said)], "doc_id long, text string, n_chars long")
    assert {r.doc_id: [c.s for c in r.c_email] for r in pii._candidates(df).collect()} == {0: ["joe@example[dot]com"], 1: [said[1]], 2: [said[2]]}
    got = {r.doc_id: (r.n_email, r.spans) for r in pii.digests(df).collect()}
    assert got[0] == (0, "email:9:28") and got[1] == (0, "email:0:26")
    red = {r.doc_id: r.text for r in pii.redaction_stage(df).collect()}
    assert red[0] == "Kontakt: [EMAIL] heute" and red[1] == "[EMAIL]"


def test_top_k(spark):
    base = table(spark, SF, "embeddings")
    odd = spark.createDataFrame([(900_001, None, 0), (900_002, [float("nan")] * 64, 0), (900_003, [None] * 64, 0), (900_020, [0.5] * 64, 0), (900_021, [0.5] * 64, 0), (900_040, [], 0)], base.schema)
    v = topk.quantised(base.unionByName(odd))
    rows = {r.vec_id: np.array(r.v + [0] * (64 - len(r.v)), dtype=object) for r in v.collect()}
    assert not {900_001, 900_002, 900_003} & set(rows)
    want = {}
    for q in (i for i in rows if i % 20 == 0):
        best = sorted((-int((rows[q] * rows[c]).sum()), c) for c in rows if c != q)[:20]
        want |= {(q, n + 1): (c, -s) for n, (s, c) in enumerate(best)}
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.top_k(v, v.filter("vec_id % 20 = 0")).collect()}
    assert got == want
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0


def test_bpe_equals_the_library(spark, docs, odd):
    t = Tokenizer.from_file(bpe.tokenizer_path())
    df = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    want = sorted((r.doc_id or -1, len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()) for r in df.collect() for e in [t.encode(r.text or "", add_special_tokens=False)])
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df).collect()) == want


def test_warc(spark):
    p = table(spark, SF, "pages")
    p = p.unionByName(p.filter("page_id < 40").withColumn("page_id", F.col("page_id") + 10_000)).unionByName(spark.createDataFrame([(90_001, None, None), (90_002, "u", ""), (90_003, "a\r\nb", "\x1f\x8b\x08" * 50)], p.schema))
    html = {r.page_id: (r.html or "").encode() for r in p.collect()}
    last = {}
    for i, h in html.items():
        last[h] = max(i, last.get(h, i))
    got = warc.read_archives(spark, warc.write_archives(p), 20_000).collect()
    assert {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == {(i, len(h), warc.base32_sha1(h), "response" if last[h] == i else "revisit", None if last[h] == i else last[h]) for i, h in html.items()}
    assert len(got) == len(html)


def test_url_filter(spark):
    rows = ["http://a.NET/x?y", "https://x.example.net/en/1", "http://example.com/de/2", "http://example.com/fr/2", "http://q.org/fr/", "http://q.org/de/", "nonsense", None, "http://b.net", "://example.net:80/en/"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string").unionByName(table(spark, SF, "pages").select((F.col("page_id") + 100).alias("page_id"), "url"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block") and got[1][2:] == ("example.net/en/", "allow") and got[2][2:] == ("example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow")
    assert got[6][:3] == got[7][:3] == ("", "", None) and got[8][:3] == ("b.net", "", None) and got[9][0] == "example.net:80" and got[9][2] is None
    assert len(got) == df.count() and {v[3] for v in got.values()} <= {"allow", "block"}


def test_token_files(spark, docs):
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    t, at, want = Tokenizer.from_file(bpe.tokenizer_path()), 0, []
    for r in df.orderBy("doc_id").collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r)[:4] for r in token_files.read_files(token_files.write_files(df)).orderBy("doc_id").collect()] == want


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 3000])
def test_packed_blocks(n):
    ids = np.random.default_rng(n).integers(0, 50_000, n).astype(np.uint32)
    ids[::40] = 2**32 - 1
    p = token_files.Packed(token_files.pack(ids))
    assert (p.ids() == ids).all() and (p.ids(n // 3, n // 2) == ids[n // 3 : n // 2]).all()


def test_sharding(spark, docs, odd):
    got = sharding.shard(sharding.measured(docs), 16).orderBy("doc_id").collect()
    whole, at, slots = sum(r.size for r in got), 0, {}
    for r, d in zip(got, docs.orderBy("doc_id").collect(), strict=True):
        raw = (d.text or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw)) and r.shard == min(15, int((2 * at + r.size) / (2 * whole) * 16)) and r.slot == slots.get(r.shard, 0)
        at, slots[r.shard] = at + r.size, r.slot + 1
    assert sharding.shard(sharding.measured(odd), 4).count() == odd.count() and sharding.shard(sharding.measured(odd.limit(0)), 4).count() == 0


def test_decontamination(spark):
    items = spark.createDataFrame([(1, "Tom bought 3 apples and 12 pears for 5 dollars at the market near the river."), (2, None), (3, "one two"), (4, "A farmer paid 3 coins and then 3 coins more to the man at the gate")], "item_id long, text string")
    texts = ["He said: Anna bought 7 apples and 30 pears for 9 euros at the market near the river today", "the farmer paid 4 coins and then 4 coins more to the man at the gate", "farmer paid 4 coins and then 5 coins more to the man", None, "", "clean words without any of that", "here one two there"]
    got = {r.doc_id: r.item_ids for r in decontam.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), items).collect()}
    assert got == {0: [1], 1: [4], 6: [3]}


def test_decontamination_finds_copies_of_number_dense_items(spark):
    said = ["What is 12 + 7 * 3 - 4?", "Compute 17 * 23 + 41 * 19 - 8 / 2", "Find the next term: 2, 3, 5, 8, 13, 21, 34, 55, 89, 144", "5 km 7 kg"]
    items = spark.createDataFrame(list(enumerate(said)), "item_id long, text string")
    texts = [*(f"in 9 {t.lower()} minutes" for t in said), "what is 12 + 7 * 3 - 5?", "Compute 17 * 23 + 41 * 19 - 8 / 3", "1 2 3 4 5 6 7 8 9 10 11 12"]
    got = {r.doc_id: r.item_ids for r in decontam.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), items).collect()}
    assert got == {0: [0], 1: [1], 2: [2]}


def test_pipeline(spark, docs):
    import corpus_pipeline

    kept = [r.doc_id for r in docs.select("doc_id").collect()]
    df = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = Scratch(spark, "t").write(name, stage(spark, df, SF))
        assert out.columns == docs.columns and {r.doc_id for r in out.select("doc_id").collect()} <= set(kept)
        if name == "jaccard_join":
            rows = [(r.doc_id, r.text) for r in df.collect()]
            want = {c for _, c in _groups(rows, 5, 80).values()}
            assert {r.doc_id for r in out.collect()} == want
        kept, df = [r.doc_id for r in out.select("doc_id").collect()], out
    last = corpus_pipeline.STAGES[-1][1](spark, df, SF)
    assert last.join(df.select("doc_id", "text"), "doc_id").filter("decoded <> text").count() == 0 and last.count() == len(kept)


def test_vocabulary_file_is_plain():
    assert "merges" in json.load(open(bpe.tokenizer_path()))["model"]
