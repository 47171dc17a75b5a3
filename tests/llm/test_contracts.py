"""Rules that hold for every operator and stage: nulls, repeated rows, empty tables, clashing names, long texts; and brute force where SQL has no word for it."""

import math
import re
import time
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import bpe, decontam, jaccard_join, langid, pii, pieces, queries, sharding, token_files, topk, url_filter, warc
from corpusmill.llm.common import anti_join, semi_join, table, text_key

SF = "/root/testdata/sf0.001"
ENGLISH = "the people of the town have seen that there is no other way to the house on the hill"
#: Names that the operators use inside.
CLASHING = ["_slot", "_hit", "_bits", "_id", "_own", "_other", "_row", "row", "base_email", "all_email", "_all", "_new", "b_email", "c_ip", "_taken", "every", "heads", "new", "id", "n", "component", "a.b"]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "Tom bought 3 apples and 12 pears for 5 dollars at the market near the river.")], "item_id long, text string")


def _stages(items):
    return {
        "language": langid.language_stage, "near": jaccard_join.near_duplicate_stage,
        "decontamination": lambda df: decontam.decontamination_stage(df, items), "pii": pii.redaction_stage,
    }


@pytest.mark.parametrize("stage", ["language", "near", "decontamination", "pii"])
def test_clashing_names_and_empty_tables(spark, docs, items, stage):
    run = _stages(items)[stage]
    more = docs.limit(60)
    plain = {r.doc_id: r.text for r in run(more).collect()}
    for name in CLASHING:
        more = more.withColumn(name, F.concat(F.lit(f"{name}-"), F.col("doc_id").cast("string")))
    got = run(more)
    assert got.columns == more.columns and got.schema.simpleString() == more.schema.simpleString()
    rows = got.collect()
    assert {r.doc_id: r.text for r in rows} == plain
    assert all(r[name] == f"{name}-{r.doc_id}" for r in rows for name in CLASHING)
    assert run(more.limit(0)).count() == 0


def _kept(run, spark, rows):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in run(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect())


def test_stages_judge_rows_of_null_and_repeated_ids_by_their_texts(spark, items):
    leak = "Anna bought 7 apples and 30 pears for 9 euros at the market near the river"
    other = " ".join(f"word{i}" for i in range(40))
    near = other.replace(" word39", "")
    rows = [(i, ENGLISH + f" {i}", "en", "s", 1) for i in range(30)]
    clean = [(i, t) for i, t, *_ in rows]
    language = [*rows, (1, "123", None, "s", 1), (None, "456", None, "s", 1), (None, ENGLISH, None, "s", 1)]
    assert _kept(langid.language_stage, spark, language) == sorted([*clean, (-1, ENGLISH)])
    leaks = [*rows, (1, leak, None, "s", 1), (None, leak, None, "s", 1), (None, ENGLISH, None, "s", 1)]
    assert _kept(lambda df: decontam.decontamination_stage(df, items), spark, leaks) == sorted([*clean, (-1, ENGLISH)])
    copies = [(5, other, None, "s", 1), (None, near, None, "s", 1), (5, other, None, "s", 1), (5, "quite another text that has nothing to do with it at all", None, "s", 1), (6, None, None, "s", 1), (6, None, None, "s", 1), (None, " ", None, "s", 1)]
    assert _kept(jaccard_join.near_duplicate_stage, spark, copies) == sorted([(5, other), (5, "quite another text that has nothing to do with it at all"), (6, ""), (6, ""), (-1, " ")])
    found = jaccard_join.jaccard_groups(spark.createDataFrame([r[:2] for r in copies], "doc_id long, text string")).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in found) == sorted([(5, 36, 5), (5, 36, 5), (-1, 35, 5), (5, 8, 5), (6, 0, 6), (6, 0, 6), (-1, 0, -1)])


def test_texts_in_no_learned_language_go(spark):
    rows = [(i, ENGLISH + f" {i}", "en", "s", 1) for i in range(30)] + [(100, "съешь ещё этих мягких французских булок да выпей чаю " * 3, None, "s", 1), (101, "明日は雨が降るでしょう" * 5, None, "s", 1)]
    assert {i for i, _ in _kept(langid.language_stage, spark, rows)} == set(range(30))


def test_the_bound_of_the_language_stage_comes_from_rows_not_learned_from(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.train(docs)
    assert model.most_bits < langid.NO_LANGUAGE
    said = {
        "en": "The girl bought fresh bread at the market near the old church and then walked home with her friend", "keys": "token = b64b244acde2e3b0aa8f051af1ec018ebaba3add and of the house",
        "nl": "Het meisje heeft vers brood gekocht op de markt bij de oude kerk en liep daarna met haar vriendin naar huis", "pl": "Dziewczyna kupiła świeży chleb na targu w pobliżu starego kościoła, a potem poszła do domu",
        "ru": "съешь ещё этих мягких французских булок да выпей чаю", "ja": "明日は雨が降るでしょう", "null": None, "": "", "words": "x" * 300_000,
    }
    rates = dict(zip(said, langid._judged(model, list(said.values()), words=True)[2], strict=True))
    assert all(rates[k] <= model.most_bits for k in ("en", "keys")) and all(rates[k] > model.most_bits for k in ("nl", "pl", "ru", "ja"))
    slow = langid._judged(model, ["a bb ccc. " * 40_000, "é"], words=True)
    assert slow[0][0] != "und" and len(slow[2]) == 2 and rates["null"] == rates[""] == 0


def test_words_cost_what_their_bytes_cost():
    model = langid.PPM({"x": [b"the cat sat on the mat"], "y": [b"der hund"]})
    texts = [b"the hat  a dog\n", b"", b" ", b"a", b"der" * 5]
    totals, typical = model.rated(texts)
    assert np.allclose(totals, model.totals(texts))
    for t, total, got in zip(texts, totals, typical, strict=True):
        bits = model.code_lengths(np.frombuffer(langid.PAD + t, np.uint8))[:, total.argmin()] if t else np.zeros(0)
        words = [m.span() for m in re.finditer(rb"[^\x00-\x20]+", t)]
        rates = sorted(float(bits[a:b].sum()) / (b - a) for a, b in [w for w in words if w[1] - w[0] > 1] or words)
        assert got == pytest.approx(rates[(len(rates) - 1) // 2] if rates else 0, rel=1e-5)


def test_ppm_equals_a_naive_one():
    texts = {"x": [b"the cat sat on the mat", b"the hat"], "y": [b"der hund und die katze"]}
    model = langid.PPM(texts)

    def naive(own: list[bytes], context: bytes, symbol: int) -> float:
        """Bits of a byte: escape method C with exclusions, orders 3 to 0, then uniform bytes."""
        counts = [{} for _ in range(langid.ORDER + 1)]
        for t in own:
            padded = langid.PAD + t
            for i in range(langid.ORDER, len(padded)):
                for n in range(langid.ORDER + 1):
                    seen = counts[n].setdefault(padded[i - n : i], {})
                    seen[padded[i]] = seen.get(padded[i], 0) + 1

        def probability(n: int, s: int) -> float:
            if n < 0:
                return 1 / 256
            seen = counts[n].get(context[len(context) - n :] if n else b"", {})
            if not seen:
                return probability(n - 1, s)
            total = sum(seen.values()) + len(seen)
            if s in seen:
                return seen[s] / total
            covered = sum(probability(n - 1, o) for o in seen)
            return len(seen) / total * probability(n - 1, s) / max(1 - covered, 1e-9)

        return -math.log2(probability(langid.ORDER, symbol))

    text = b"the kat sas"
    padded = langid.PAD + text
    for j, name in enumerate(model.languages):
        want = sum(naive(texts[name], padded[i - langid.ORDER : i], padded[i]) for i in range(langid.ORDER, len(padded)))
        assert model.totals([text])[0][j] == pytest.approx(want, rel=1e-4)


def test_redaction_equals_a_plain_one_and_long_texts_are_linear(spark):
    texts = ["a@b.co 1.2.3.4 and 1.2.3.4@c.de é😀 x@y.z", "nothing", None, "", "4111 1111 1111 1111+1 (017) 555-7713"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    found = {r.doc_id: sorted((s, e, k) for k in pii.KINDS for s, e in r[f"all_{k}"]) for r in pii.spans(df).collect()}
    for r in pii.redaction_stage(df).collect():
        text, at, out = texts[r.doc_id], 0, ""
        for s, e, k in found[r.doc_id]:
            if s >= at:
                out += text[at:s] + f"[{k.upper()}]"
            at = max(at, e)
        assert r.text == (None if text is None else out + text[at:]) and r.n_chars == (None if text is None else len(r.text))
    took = []
    for n in (4000, 16000):
        long = spark.createDataFrame([(1, " ".join(f"10.{i % 256}.{i // 256 % 256}.7" for i in range(n)))], "doc_id long, text string")
        began = time.time()
        (row,) = pii.redaction_stage(long).collect()
        took.append(time.time() - began)
        assert row.text == " ".join(["[IP]"] * n)
    assert took[1] < 4 * took[0] + 6


def test_empty_tables(spark, docs, items):
    none = docs.limit(0)
    pages = table(spark, SF, "pages").limit(0)
    assert pii.digests(none).count() == pii.redaction_stage(none).count() == 0
    assert warc.read_archives(spark, warc.write_archives(pages)).count() == 0
    assert url_filter.judge(pages).count() == 0
    assert token_files.read_files(token_files.write_files(none)).count() == 0
    assert bpe.digests(none).count() == bpe.encode(none).count() == 0
    assert decontam.contaminated(none, items).count() == decontam.contaminated(docs, items.limit(0)).count() == 0


def test_joins_keep_columns_and_null_keys(spark):
    rows = spark.createDataFrame([(1, "x", 5), (2, None, 6), (None, "z", 7), (1, "x", 8)], "_id long, _slot string, _own int")
    ids = spark.createDataFrame([(1,), (None,)], "k long")
    assert sorted(r["_own"] for r in anti_join(rows, ids, "_id", "k").collect()) == [6, 7]
    assert sorted(r["_own"] for r in semi_join(rows, ids, "_id", "k").collect()) == [5, 8]
    keyed = rows.select(text_key("_slot").alias("k")).filter("k <> ''").distinct()
    assert sorted(r["_own"] for r in anti_join(rows, keyed, text_key("_slot"), "k").collect()) == [6]


def test_top_k_of_huge_components(spark):
    huge = [(20, [2e15, 0.0]), (1, [2e15, 1.0]), (2, [-4e9, 4e9]), (3, [1e-3, -1.0]), (4, [1.0, 4e3])]
    v = topk.quantised(spark.createDataFrame(huge, "vec_id long, embedding array<double>"))
    assert v.count() == len(huge)
    with pytest.raises(Exception, match="too large for a long"):
        topk.top_k(v, v.filter("vec_id = 20")).collect()
    fine = v.filter("vec_id <> 1 AND vec_id <> 2")
    got = [(r.vec_id, r.score) for r in topk.top_k(fine, fine.filter("vec_id = 20")).orderBy("rank").collect()]
    assert got == [(4, int(64 * 2e15) * 64), (3, 0)]
    with pytest.raises(Exception, match="too large"):
        topk.quantised(spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>")).collect()


@pytest.mark.parametrize("k", [1, 7])
def test_top_k_in_rounds(spark, monkeypatch, k):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 8)
    r = np.random.default_rng(k)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(r.normal(size=(400, 3)))] + [(1000 + i, [0.5, 0.5, 0.5]) for i in range(60)]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    told = {x.vec_id: np.array(x.v) for x in v.collect()}
    want = {(q, n + 1): (c, -s) for q in told if q % 20 == 0 for n, (s, c) in enumerate(sorted((-int(told[q] @ told[c]), c) for c in told if c != q)[:k])}
    assert {(x.query_id, x.rank): (x.vec_id, x.score) for x in topk.top_k(v, v.filter("vec_id % 20 = 0"), k=k).collect()} == want


def test_sharding_keeps_its_law(spark, docs):
    rows = [r.asDict() for r in queries.op9_sharding(spark, SF).collect()]
    assert len(rows) == docs.count() and {r["law"] for r in rows} == {"bytes"}
    sums = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(16)]
    assert max(sums) - min(sums) <= 2 * max(r["size"] for r in rows) and sum(sums) == sum(len((d.text or "").encode()) + 1 for d in docs.collect())
    for s in range(16):
        own = sorted((r["slot"], r["doc_id"]) for r in rows if r["shard"] == s)
        assert [slot for slot, _ in own] == list(range(len(own))) and [d for _, d in own] == sorted(d for _, d in own)
    assert sharding.shard(sharding.measured(docs.limit(0)), 16).count() == 0


def _naive_leaks(items: dict[int, str], text: str) -> set[int]:
    """The items of which a window of `WINDOW` tokens (or the whole item) stands in the text, as the module says, by plain loops."""

    def tokens(t):
        return re.findall(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[%$€£°]", unicodedata.normalize("NFC", t or ""))

    def kind(own, i, first):
        t = own[i]
        if t[0].isnumeric():
            return "number"
        if t.lower() in decontam.UNITS:
            return "unit" if i > first and own[i - 1][0].isnumeric() else "loose"
        return "name" if t[0].isupper() and (len(t) == 1 or not t.isupper()) else "word"

    def readings(own, at, size):
        window = [(t, kind(own, at + j, 0)) for j, t in enumerate(own[at : at + size])]
        for reading in (1, 2):
            slots = [k in ("number", "unit") or (reading == 2 and k == "name") for _, k in window]
            if 2 * sum(slots) <= size and (reading == 1 or any(k == "name" for _, k in window)):
                form = tuple(k if s else t.lower() for (t, k), s in zip(window, slots, strict=True))
                yield reading, form, [t.lower() for (t, _), s in zip(window, slots, strict=True) if s]
        if 2 * sum(k in ("number", "unit", "loose") for _, k in window) > size:
            yield 3, tuple(t.lower() for t, _ in window), []

    said, out = tokens(text), set()
    for item, t in items.items():
        own = tokens(t)
        if len(own) < decontam.WINDOW and not any(kind(own, i, 0) in ("word", "name") for i in range(len(own))):
            continue
        size = min(decontam.WINDOW, len(own))
        theirs = [r for at in range(len(own) - size + 1) for r in readings(own, at, size)]
        ours = [r for at in range(len(said) - size + 1) for r in readings(said, at, size)]
        for reading, form, values in theirs:
            for other, form2, values2 in ours:
                if reading == other and form == form2 and len(set(zip(values, values2, strict=True))) == len(set(values)):
                    out.add(item)
    return out


def test_decontamination_equals_plain_loops(spark):
    benchmark = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
    dice = np.random.default_rng(4)
    texts = []
    for t in list(benchmark.values())[:12]:
        words = t.split()
        texts += [t, "x " + t + " y", re.sub(r"\d+", lambda m: str(int(m.group()) % 1000 + 3), t), " ".join(dice.permutation(words)), " ".join(words[: len(words) // 2])]
    texts += ["no number 5 km 7 kg at all", None, "", "so 1 1 2 3 5 8 13 21 34 55 89 144 km and on", "1 1 2 3 5 8 13 21 34 99 is none", "12 km"]
    benchmark |= {9001: "1 1 2 3 5 8 13 21 34 55 89", 9002: "12 km"}
    items = spark.createDataFrame(list(benchmark.items()), "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: set(r.item_ids) for r in decontam.contaminated(df, items).collect()}
    want = {i: found for i, t in enumerate(texts) if (found := _naive_leaks(benchmark, t))}
    assert got == want and any(9001 in found for found in got.values()) and not any(9002 in found for found in got.values())
    with pytest.raises(ValueError, match="tokens"):
        decontam.contaminated(df, items, 257)


def test_pieces_forget_and_stay_right(monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.tokenizer_path())
    atoms = ["a", "foo", "Don't", "'s", "'ll", " ", "  ", "\n", " \n", "\t", "\r\n", "1", ".", "!!", "é", "ß", "日本", "\x1c", "\x85", "\x00", "<|endoftext|>", "<|endof", "　", "​", "😀", "_", "aaaaaaa", "\xa0", " ", "x" * 40]
    dice = np.random.default_rng(3)
    texts = ["", " ", "a ", "a  b", None, *("".join(dice.choice(atoms, dice.integers(1, 30))) for _ in range(3000))]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for most, long in ((10**6, 10**6), (60, 10**6), (10**6, 100)):
        monkeypatch.setattr(pieces, "MOST_PIECES", most)
        monkeypatch.setattr(pieces, "MOST_LONG_BYTES", long)
        encoder = bpe.PairIndexBPE(bpe.Vocabulary(bpe.tokenizer_path()))
        assert [i.tolist() for at in range(0, len(texts), 50) for i in encoder.encode(texts[at : at + 50])] == want
    assert encoder.encode([]) == []


def test_every_character_is_cut_as_the_library_cuts_it():
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(bpe.tokenizer_path()), bpe.PairIndexBPE(bpe.Vocabulary(bpe.tokenizer_path()))
    for low in range(1, 0x20000, 64):
        chars = [chr(c) for c in range(low, low + 64) if not 0xD800 <= c < 0xE000]
        texts = [f"a{c}b {c}1 {c} {c}{c}" for c in chars]
        assert [i.tolist() for i in encoder.encode(texts)] == [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)], hex(low)
