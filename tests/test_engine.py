import check_oracle
import pytest
from pyspark.sql import functions as F

from corpusmill import catalog
from corpusmill.functions import urls
from corpusmill.operators import arena, dedup, kernels, metrics, quality, rewards, safety, shaping, tokens
from corpusmill.plans import pipelines
from corpusmill.streaming import stateful

FAST = ["quality_filter", "content_filter", "pii_redact", "gopher_filter", "normalize_refined", "exact_dedup", "lsh_candidates", "edu_score", "fineweb_stats", "url_valid", "token_shards", "chatml_format", "rouge_n", "bleu", "macro_accuracy", "extract_answer", "math_reward", "wilson_interval", "agreement_rate", "top_k_filter", "top_p_filter", "gae", "preference_loss"]


@pytest.mark.parametrize("name", FAST)
def test_against_sql(spark, name):
    assert check_oracle.compare(spark, check_oracle.connect(), name).startswith("equal"), name


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _passed(spark, texts, f, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r[0] for r in f(df).orderBy("doc_id").select(f"{column}.passed").collect()]


def test_quality_rules(spark):
    good = "The committee met again to discuss several plans for rebuilding the old library near the river, and after a long debate they agreed that the work should start next spring with local builders.\nA second report will follow soon.\nNobody objected.\nThe end."
    assert _passed(spark, [good, "Short text.", "#@$#@$#@$ " * 50 + good, None, ""], quality.quality, "quality") == [True, False, False, False, False]
    lines = ["a b", "a\nb", "a\nb\nc", "a\nb\nc\nd"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, text string")
    shares = [r[0] for r in quality.measures(df).orderBy("i").select("q_repeats").collect()]
    assert [s <= 0.3 for s in shares] == [True, False, False, True]


def test_gram_ties_go_to_the_first(spark):
    df = spark.createDataFrame([("aa bb c d aa bb c d",)], "text string")
    assert quality.top_gram_share(df, sizes=(2,)).first().gram_share[0] == pytest.approx(5 * 2 / 19)


def test_harmful_and_private(spark):
    body = "The committee met again to discuss several plans for rebuilding the old library near the river and the builders agreed.\nOne.\nTwo here.\nThree there."
    df = spark.createDataFrame([(1, body + " kill all of them"), (2, body + " kill all of them a@b.com"), (3, body), (4, body)], "doc_id long, text string")
    got = {r.doc_id: (r.fail_stage, r.redacted) for r in pipelines.refinedweb(df, near=False).collect()}
    assert got == {1: ("content", False), 2: (None, True), 3: (None, False), 4: ("exact_duplicate", False)}


def test_redaction_order(spark):
    df = spark.createDataFrame([("ssn 123-45-6789 mail a.b@c.org ip 10.0.0.1 pass AB1234567 card 1234-5678-1234-5678",)], "text string")
    r = safety.redact(df).first()
    assert r.pii_types == ["ssn", "credit_card", "email", "ip_address", "passport"] and "6789" not in r.redacted


def test_greedy_chain(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,)], "doc_id long")
    buckets = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (3, 2)], "doc_id long, bucket long")
    assert sorted(r[0] for r in dedup.greedy_keep(ids, buckets).collect()) == [1, 3, 4]


def test_near_dedup(spark):
    t = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, t), (2, t), (3, t + " more"), (4, "quite other words stand here in a row"), (5, None)], "doc_id long, text string")
    assert {1, 4, 5} <= {r.doc_id for r in dedup.near_dedup(df).collect()} <= {1, 3, 4, 5}


def test_urls(spark):
    df = spark.createDataFrame([(0, "HTTP://Ex.COM:80/a/?b=2&a=1&c=#f"), (1, "http://ex.com/a?a=1&b=2"), (2, None), (3, "http://[bad")], "i long, u string")
    out = [r[0] for r in df.select("i", urls.normalize_url("u").alias("n")).orderBy("i").select("n").collect()]
    assert out[0] == out[1] == "http://ex.com/a?a=1&b=2" and out[2] is None and out[3] == "http://[bad"
    assert urls.deduplicate(df, "u", "i").count() == 3
    h = spark.createDataFrame([("<title>T</title><nav>x</nav><p>Hello&amp; <a href='/b'>link</a></p><script>1</script>",)], "h string").select(urls.parse_html("h").alias("p")).first().p
    assert (h.title, h.text, h.links) == ("T", "T Hello& link", ["/b"])


def test_bpe_round_trip(spark, tmp_path):
    texts = ["the cat sat on the mat", "a \\n b é😀", "", None, "the the the"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "doc_id long, text string")
    b = tokens.BPE.train(df, 300, 1)
    b.save(str(tmp_path / "t"))
    b = tokens.BPE.load(str(tmp_path / "t"))
    back = df.withColumn("ids", b.encode(F.col("text"))).select("text", b.decode_column(F.col("ids")).alias("back"))
    assert all((r.text or "") == r.back for r in back.collect()) and len(b.vocab) > 260


def test_shards(spark, tmp_path):
    df = spark.createDataFrame([(1, [1] * 6), (2, [2] * 6), (3, [70000] * 6)], "doc_id long, ids array<int>").withColumn("n", F.size("ids"))
    s = tokens.assign_shards(df, 10)
    assert [r.shard_id for r in s.orderBy("doc_id").collect()] == [0, 0, 1]
    tokens.write_bins(df.join(s.select("doc_id", "shard_id"), "doc_id"), str(tmp_path / "b")).collect()
    got = {r.path[-9:]: r.ids for r in tokens.read_bins(spark, str(tmp_path / "b")).collect()}
    assert got == {"00000.bin": [1] * 6 + [2] * 6, "00001.bin": [65535] * 6}


def test_metrics(spark):
    df = spark.createDataFrame([(1, "a b c d e", "a b c d e"), (2, "", "x"), (3, "p q", "q p")], "id long, hyp string, ref string")
    assert metrics.bleu(df.filter("id = 1")).first().bleu == pytest.approx(100)
    assert metrics.bleu(df.filter("id = 2")).first().bleu == 0
    assert {r.id: round(r.rougeL, 3) for r in metrics.rouge_l(df).collect()} == {1: 1.0, 2: 0.0, 3: 0.5}


def test_rewards(spark):
    fence = "```python\nprint(12)\n```"
    rows = [
        ("json", '{"a": 1}', "json", None, 1.0), ("json", '{"a": 1', "json", None, 0.0),
        ("code", fence, "12", "12\n", 1.0), ("code", fence, "1", "12", 0.5), ("code", fence, "123", "12", 0.5), ("code", fence, "1", "", 0.5), ("code", fence, "7", "12", 0.1),
        ("code", fence, "7", None, -0.3), ("code", "x = (", "1", "1", -0.5), ("code", "```python\n```", "1", "1", -1.0), ("code", "", "1", "1", -1.0), ("code", "see `x = (\n1)`", "1", "1", 1.0),
        ("code", "```python x = (```", "1", "1", -1.0),  # no line end, so the first two backticks hold nothing
        ("math", "the answer is 42", "42", None, 1.0), ("math", "none", "42", None, 0.0), ("math", "the answer is 101", "100", None, -0.005), ("math", "the answer is 100.9", "100", None, 1.0),
        ("math", "= 0", "0", None, 1.0), ("math", "= 1", "0", None, -0.5), ("math", "= 5", "no", None, 0.0), ("math", "= 1234", "1,234", None, 1.0), ("math", "from 3 to 9", "9", None, 1.0), ("poem", "x", "x", None, 0.0),
    ]
    df = spark.createDataFrame(rows, "task string, response string, truth string, stdout string, want double")
    told = df.select("*", F.when(F.col("task") == "json", rewards.format_reward(F.col("response"), F.col("truth"))).otherwise(rewards.reward(F.col("task"), F.col("response"), F.col("truth"), F.col("stdout"))).alias("got"))
    for r in told.collect():
        assert r.got == pytest.approx(r.want), r


def test_ratings(spark):
    df = spark.createDataFrame([(i, "x", "y", "a") for i in range(10)] + [(10, "y", "x", "tie")], "comparison_id long, model_a string, model_b string, winner string")
    board = arena.leaderboard(df).orderBy("rank").collect()
    assert [r.model for r in board] == ["x", "y"] and board[0].elo + board[1].elo == pytest.approx(2000, abs=0.2)


def test_rate_limit_and_stream(spark, tmp_path):
    rows = [(i, 1, t) for i, t in enumerate([0, 1, 2, 11])]
    df = spark.createDataFrame(rows, "event_id long, user_id long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    want = {0: True, 1: True, 2: False, 3: True}
    assert {r.event_id: r.allowed for r in kernels.rate_limit(df, 2, 10).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = stateful.rate_limit_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 2, 10).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.event_id: r.allowed for r in spark.table("limited").collect()} == want


def test_shaping(spark):
    m = spark.createDataFrame([([("user", "hi"), ("assistant", "yo")],)], "messages array<struct<role:string,content:string>>")
    text, spans = m.select(shaping.format_messages(F.col("messages")), shaping.char_mask(F.col("messages"))).first()
    assert text[spans[0].start : spans[0].end] == "yo<|im_end|>\n"


def test_catalog_has_no_gaps():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 45
