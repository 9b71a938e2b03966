"""Queries on texts, answers, scores, rewards and raw sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerloom.functions import media, metrics, text
from answerloom.functions.tables import PROMPT_REASONING, PROMPT_SHORT
from answerloom.operators import ingest, runs, splits, tables
from answerloom.plans import duck
from answerloom.plans.inputs import COMPLETIONS, EXAMPLES, PANELS, PREDICTIONS, completions, examples, panels, predictions, table
from answerloom.plans.registry import query
from answerloom.sources import files

DOCS = "docs AS (SELECT doc_id, text AS t FROM documents)"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"))


@query(f"WITH {DOCS} SELECT doc_id, {duck.normalize('t')} AS normalized FROM docs")
def normalize_answer(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", text.normalize_answer(F.col("t")).alias("normalized"))


@query(rf"WITH {DOCS} SELECT doc_id, {duck.strip('t')} AS stripped, lower(regexp_replace({duck.strip('t')}, '\.$', '')) AS cleaned, split_part(t, chr(10), 1) AS line FROM docs")
def strip_clean_first_line(spark, sf_dir):
    t = F.col("t")
    return docs(spark, sf_dir).select("doc_id", text.strip(t).alias("stripped"), text.clean_answer(t).alias("cleaned"), text.first_line(t).alias("line"))


@query(f"WITH {COMPLETIONS} SELECT conv_id, turn, {duck.lenient('raw')} AS answer FROM completions")
def extract_answer_lenient(spark, sf_dir):
    return completions(spark, sf_dir).select("conv_id", "turn", text.extract_answer(F.col("raw")).alias("answer"))


@query(f"WITH {COMPLETIONS} SELECT conv_id, turn, {duck.strict('raw')} AS answer FROM completions")
def extract_answer_strict(spark, sf_dir):
    return completions(spark, sf_dir).select("conv_id", "turn", text.strict_answer(F.col("raw")).alias("answer"))


@query(
    f"WITH {COMPLETIONS} SELECT conv_id, turn, CASE WHEN regexp_matches(raw, '(?s)<answer>(.*?)</answer>') THEN {duck.strip("regexp_extract(raw, '(?s)^(.*)<answer>.*?</answer>', 1)")} END AS reasoning, {duck.strict('raw')} AS answer FROM completions"
)
def split_reasoning(spark, sf_dir):
    raw = F.col("raw")
    return completions(spark, sf_dir).select("conv_id", "turn", text.reasoning_part(raw).alias("reasoning"), text.strict_answer(raw).alias("answer"))


@query(f"WITH {PANELS} SELECT key, CAST({duck.matches('prediction', 'golds')} > 0 AS DOUBLE) AS score FROM panels")
def exact_match(spark, sf_dir):
    return panels(spark, sf_dir).select("key", metrics.exact_match(F.col("prediction"), F.col("golds")).alias("score"))


@query(f"WITH {PANELS}, f AS (SELECT key, {duck.fraction(repr('vqav2'), 'prediction', 'golds')} AS f FROM panels) SELECT key, f[1] / f[2] AS score FROM f")
def panel_accuracy(spark, sf_dir):
    return panels(spark, sf_dir).select("key", metrics.panel_accuracy(F.col("prediction"), F.col("golds")).alias("score"))


@query(f"WITH {PANELS}, f AS (SELECT key, dataset, {duck.fraction('dataset', 'prediction', 'golds')} AS f FROM panels) SELECT key, dataset, f[1] / f[2] AS score FROM f")
def score_dispatch(spark, sf_dir):
    return panels(spark, sf_dir).select("key", "dataset", metrics.score(F.col("dataset"), F.col("prediction"), F.col("golds")).alias("score"))


SCORED = f"""scored AS (SELECT conv_id, turn, dataset, raw, question, golds, {duck.strict('raw')} AS answer FROM completions),
rewarded AS (SELECT *, CASE WHEN answer IS NULL THEN 0.0 ELSE {duck.bound(duck.fraction('dataset', 'answer', 'golds'), 'f_', 'f_[1] / f_[2]')} END AS correctness FROM scored)"""
#: Well-formedness: one tag that ends the text, reasoning before it, a short answer in it.
FORMAT = f"""(SELECT (length(s_) - length(replace(s_, '<answer>', ''))) = 8 AND ends_with(s_, '</answer>')
  AND length({duck.strip("split_part(s_, '<answer>', 1)")}) >= 100
  AND length({duck.strip("regexp_extract(s_, '(?s)<answer>(.*)</answer>$', 1)")}) BETWEEN 1 AND 80
  AND NOT contains({duck.strip("regexp_extract(s_, '(?s)<answer>(.*)</answer>$', 1)")}, '<') FROM (SELECT {duck.strip('raw')} AS s_))"""


@query(f"WITH {COMPLETIONS}, {SCORED} SELECT conv_id, turn, CAST(correctness AS DOUBLE) AS reward FROM rewarded")
def correctness_reward(spark, sf_dir):
    return completions(spark, sf_dir).select("conv_id", "turn", metrics.correctness_reward(F.col("dataset"), F.col("raw"), F.col("golds")).alias("reward"))


@query(f"WITH {COMPLETIONS} SELECT conv_id, turn, CAST({FORMAT} AS DOUBLE) AS reward FROM completions")
def format_reward(spark, sf_dir):
    return completions(spark, sf_dir).select("conv_id", "turn", metrics.format_reward(F.col("raw")).alias("reward"))


@query(f"WITH {COMPLETIONS}, {SCORED} SELECT conv_id, turn, 1.0::DOUBLE * correctness + 0.2::DOUBLE * CAST({FORMAT} AS DOUBLE) AS reward FROM rewarded")
def weighted_reward(spark, sf_dir):
    reward = metrics.weighted_reward(["correctness", "format"], F.col("dataset"), F.col("raw"), F.col("golds"))
    return completions(spark, sf_dir).select("conv_id", "turn", reward.alias("reward"))


@query(
    f"""WITH {COMPLETIONS}, {SCORED}, s AS (SELECT avg(correctness) AS m, stddev_samp(correctness) AS s, dataset FROM rewarded GROUP BY dataset)
SELECT r.conv_id, r.turn, round(CASE WHEN s > 0 THEN (correctness - m) / s ELSE 0 END, 6) AS advantage FROM rewarded r JOIN s USING (dataset)"""
)
def group_advantage(spark, sf_dir):
    rewards = completions(spark, sf_dir).select("conv_id", "turn", "dataset", metrics.correctness_reward(F.col("dataset"), F.col("raw"), F.col("golds")).alias("reward"))
    return runs.advantages(rewards, "dataset").select("conv_id", "turn", F.round("advantage", 6).alias("advantage"))


MEAN = "(coalesce(sum(f[1] * (7560 // f[2])), 0) / 7560.0::DOUBLE + 0.0::DOUBLE) / count(*)"
EVAL = f"WITH {COMPLETIONS}, p AS (SELECT *, {duck.lenient('raw')} AS prediction FROM completions), f AS (SELECT *, {duck.fraction('dataset', 'prediction', 'golds')} AS f FROM p)"


def scored(spark, sf_dir):
    rows = completions(spark, sf_dir).withColumnRenamed("golds", "answers")
    return runs.rescore(rows, F.col("dataset")).withColumn("answer_type", F.when(F.col("turn") % 4 == 1, F.lit("single")).otherwise(""))


@query(f"{EVAL} SELECT dataset, count(*) AS n, {MEAN} AS score FROM f GROUP BY dataset")
def eval_overall(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("dataset").agg(F.count("*").alias("n"), runs.mean_score().alias("score"))


@query(f"{EVAL} SELECT CASE WHEN turn % 4 = 1 THEN 'single' ELSE 'all' END AS answer_type, count(*) AS n, {MEAN} AS score FROM f GROUP BY ALL")
def eval_by_answer_type(spark, sf_dir):
    return runs.by_answer_type(scored(spark, sf_dir))


@query(
    f"""{EVAL}, t AS (SELECT dataset, CASE WHEN turn % 4 = 1 THEN 'single' ELSE 'all' END AS k, count(*) AS n, {MEAN} AS s FROM f GROUP BY ALL),
o AS (SELECT dataset, count(*) AS n, {MEAN} AS s FROM f GROUP BY dataset)
SELECT o.dataset, o.n, o.s AS overall, (SELECT string_agg(k || '=' || CAST(CAST(round(s * 1e6) AS BIGINT) AS VARCHAR), ',' ORDER BY k) FROM t WHERE t.dataset = o.dataset) AS by_answer_type FROM o"""
)
def run_record(spark, sf_dir):
    records = runs.run_records(scored(spark, sf_dir), ["dataset"])
    entries = F.transform(F.map_entries("metrics.by_answer_type"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 1e6).cast("long").cast("string")))
    return records.select("dataset", "n", F.col("metrics.overall").alias("overall"), F.array_join(entries, ",").alias("by_answer_type"))


@query(
    f"""WITH {COMPLETIONS}, {EXAMPLES}, p AS (SELECT CAST(conv_id * 11 AS VARCHAR) AS qid, *, {duck.lenient('raw')} AS prediction FROM completions),
f AS (SELECT *, {duck.fraction('dataset', 'prediction', 'golds')} AS f FROM p),
t AS (SELECT coalesce(nullif(e.answer_type, ''), 'all') AS answer_type, f FROM f LEFT JOIN (SELECT qid, max(answer_type) AS answer_type FROM examples GROUP BY qid) e USING (qid))
SELECT answer_type, count(*) AS n, {MEAN} AS score FROM t GROUP BY answer_type"""
)
def rescore_left_join(spark, sf_dir):
    rows = scored(spark, sf_dir).drop("answer_type").withColumn("qid", (F.col("conv_id") * 11).cast("string"))  # some beyond the last example
    return runs.by_answer_type(runs.with_answer_type(rows, examples(spark, sf_dir)))


@query("WITH d AS (SELECT p_partkey AS key, p_size * 97 AS w, CAST(p_partkey % 50 + 1 AS INT) * 61 AS h FROM part) SELECT key, CASE WHEN w * h <= 786432 THEN w ELSE greatest(1, CAST(trunc(w * sqrt(786432.0::DOUBLE / (w * h))) AS BIGINT)) END AS w, CASE WHEN w * h <= 786432 THEN h ELSE greatest(1, CAST(trunc(h * sqrt(786432.0::DOUBLE / (w * h))) AS BIGINT)) END AS h FROM d")
def cap_pixels_dims(spark, sf_dir):
    return sizes(spark, sf_dir).select("key", media.capped(F.col("w"), F.col("h")).alias("s")).select("key", "s.*")


def sizes(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), (F.col("p_size") * 97).alias("w"), ((F.col("p_partkey") % 50 + 1).cast("int") * 61).alias("h"))


CANVAS = "WITH d AS (SELECT p_partkey AS key, p_size * 97 AS w, CAST(p_partkey % 50 + 1 AS INT) * 61 AS h FROM part), s AS (SELECT key, greatest(1, CAST(round_even(w * (608.0::DOUBLE / greatest(w, h)), 0) AS BIGINT)) AS w, greatest(1, CAST(round_even(h * (608.0::DOUBLE / greatest(w, h)), 0) AS BIGINT)) AS h FROM d)"


@query(f"{CANVAS} SELECT key, w, h, (608 - w) // 2 AS x, (608 - h) // 2 AS y FROM s")
def canvas_dims(spark, sf_dir):
    return sizes(spark, sf_dir).select("key", media.on_canvas(F.col("w"), F.col("h")).alias("s")).select("key", "s.*")


@query("WITH d AS (SELECT p_partkey AS key, p_size * 97 AS w, CAST(p_partkey % 50 + 1 AS INT) * 61 AS h FROM part) SELECT key, greatest(1, CAST(round(w * least(1.0::DOUBLE, 1024.0::DOUBLE / greatest(w, h)), 0) AS BIGINT)) AS w, greatest(1, CAST(round(h * least(1.0::DOUBLE, 1024.0::DOUBLE / greatest(w, h)), 0) AS BIGINT)) AS h FROM d")
def thumbnail_dims(spark, sf_dir):
    return sizes(spark, sf_dir).select("key", media.thumbnail(F.col("w"), F.col("h")).alias("s")).select("key", "s.*")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'data:image/png;base64,' ELSE 'data:image/jpeg;base64,' END || to_base64(CASE WHEN doc_id % 2 = 0 THEN from_hex('89504E47') ELSE ''::BLOB END || encode(text)) AS uri FROM documents")
def data_uri(spark, sf_dir):
    content = F.concat(F.when(F.col("doc_id") % 2 == 0, F.unhex(F.lit("89504E47"))).otherwise(F.unhex(F.lit(""))), F.encode("text", "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", media.data_uri(content).alias("uri"))


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * 1000) AS BIGINT)) AS v FROM embeddings)
SELECT vec_id, array_to_string(list_transform(v, lambda x: CASE (x % 3 + 3) % 3 WHEN 0 THEN x - 5 WHEN 1 THEN x ELSE x + 7 END), ',') AS logprobs FROM v"""
)
def token_logprob_lookup(spark, sf_dir):
    """Of three candidates at each position, the one that was taken, which the vector's own value names."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda e: F.floor(e.cast("double") * 1000)).alias("v"))
    ids = F.transform("v", lambda x, i: i + F.pmod(x, F.lit(3)).cast("int") - 1)
    maps = F.transform("v", lambda x, i: F.map_from_arrays(F.array(i + 1, i - 1, i), F.array(x + 7, x - 5, x)))
    return rows.select("vec_id", F.array_join(ingest.token_logprobs(ids, maps).cast("array<string>"), ",").alias("logprobs"))


@query(
    f"""SELECT 'vqav2' AS dataset, 'cauldron-' || CAST(position AS VARCHAR) || '-' || CAST(j AS VARCHAR) AS qid, 'first' || CAST(position AS VARCHAR) AS path, hex(encode('of ' || CAST(position AS VARCHAR))) AS bytes,
  {duck.strip("split_part(text, chr(10), 1)")} AS question, lower(regexp_replace({duck.strip('reply')}, '\\.$', '')) AS answers, '' AS answer_type
FROM (SELECT conv_id AS position, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS j, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations) WHERE reply IS NOT NULL"""
)
def ingest_multi_qa(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    pairs = F.transform(F.slice(ordered, F.lit(1), F.greatest(F.size(ordered) - 1, F.lit(0))), lambda x, i: F.struct(x["text"].alias("user"), F.get(ordered, i + 1)["text"].alias("assistant")))
    number = F.col("position").cast("string")
    image = lambda name: F.struct(F.encode(F.concat(F.lit("of "), number), "UTF-8").alias("bytes"), F.concat(F.lit(name), number).alias("path"))
    rows = turns.groupBy(F.col("conv_id").alias("position")).agg(pairs.alias("texts")).withColumn("images", F.array(image("first"), image("second")))
    return ingest.from_multi_qa(rows).select("dataset", "qid", "image.path", F.hex("image.bytes").alias("bytes"), "question", F.array_join("answers", "|").alias("answers"), "answer_type")


@query(f"WITH {PANELS} SELECT 'vqav2' AS dataset, CAST(key AS VARCHAR) AS qid, prediction AS question, array_to_string(golds, '|') AS answers, dataset AS answer_type FROM panels")
def ingest_annotators(spark, sf_dir):
    rows = panels(spark, sf_dir).select(F.col("key").alias("question_id"), F.lit(None).alias("image"), F.col("prediction").alias("question"), F.transform("golds", lambda g: F.struct(g.alias("answer"))).alias("answers"), F.col("dataset").alias("answer_type"))
    return ingest.from_annotators(rows).drop("image").withColumn("answers", F.array_join("answers", "|"))


@query("SELECT 'gqa' AS dataset, CAST(o_orderkey AS VARCHAR) AS qid, c_name AS image, o_orderstatus AS question, o_orderpriority AS answers, c_mktsegment AS answer_type FROM orders JOIN customer ON o_custkey = c_custkey")
def ingest_instructions(spark, sf_dir):
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    types = customers.select(F.col("c_custkey").alias("imageId"), F.struct(F.col("c_mktsegment").alias("structural")).alias("types"))
    instructions = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("imageId"), F.col("o_orderstatus").alias("question"), F.col("o_orderpriority").alias("answer")).join(types, "imageId")
    return ingest.from_instructions(instructions, customers.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("image"))).withColumn("answers", F.array_join("answers", "|"))


@query(f"WITH {COMPLETIONS} SELECT 'clevr' AS dataset, 'test-' || CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS VARCHAR) AS qid, question, {duck.lenient('raw')} AS answers, 'number' AS answer_type FROM completions")
def ingest_counting(spark, sf_dir):
    rows = completions(spark, sf_dir).select("conv_id", "turn", F.lit(None).alias("image"), F.col("question").alias("problem"), F.col("raw").alias("solution"))
    placed = splits.with_position(rows, [F.col("conv_id"), F.col("turn")])
    return ingest.from_counting(placed, "test").drop("image").withColumn("answers", F.array_join("answers", "|"))


@query(f"WITH {COMPLETIONS} SELECT 'textvqa' AS dataset, CAST(conv_id AS VARCHAR) AS qid, question, array_to_string(golds, '|') AS answers, '' AS answer_type FROM completions")
def ingest_ocr(spark, sf_dir):
    rows = completions(spark, sf_dir).select(F.col("conv_id").alias("question_id"), F.lit(None).alias("image"), "question", F.col("golds").alias("answers"))
    return ingest.from_ocr(rows).drop("image").withColumn("answers", F.array_join("answers", "|"))


def trainable(spark, sf_dir):
    """Completions as examples, with an undecoded image whose path tells them apart."""
    path = F.concat_ws("-", "conv_id", "turn")
    return completions(spark, sf_dir).select("dataset", "question", F.col("golds").alias("answers"), F.struct(F.encode("raw", "UTF-8").alias("bytes"), path.alias("path")).alias("image"))


TRAINABLE = f"{COMPLETIONS}, t AS (SELECT *, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS path, hex(encode(raw)) AS bytes FROM completions)"


@query(f"WITH {TRAINABLE} SELECT path, bytes, 'user' AS role, {duck.filled(PROMPT_SHORT, question='question')} AS prompt, 'assistant' AS reply_role, golds[1] AS reply FROM t")
def supervised_columns(spark, sf_dir):
    rows = ingest.to_supervised(trainable(spark, sf_dir))
    prompt, reply = F.get("prompt", F.lit(0)), F.get("completion", F.lit(0))
    return rows.select("image.path", F.hex("image.bytes").alias("bytes"), prompt["role"].alias("role"), prompt["content"].alias("prompt"), reply["role"].alias("reply_role"), reply["content"].alias("reply"))


@query(f"WITH {TRAINABLE} SELECT path, bytes, 'user' AS role, {duck.filled(PROMPT_REASONING, question='question')} AS prompt, array_to_string(golds, '|') AS answers, dataset, question FROM t")
def reinforcement_columns(spark, sf_dir):
    rows = ingest.to_reinforcement(trainable(spark, sf_dir))
    prompt = F.get("prompt", F.lit(0))
    return rows.select("image.path", F.hex("image.bytes").alias("bytes"), prompt["role"].alias("role"), prompt["content"].alias("prompt"), F.array_join("answers", "|").alias("answers"), "dataset", "question")


@query(
    f"""SELECT doc_id, '[{{"role":"user","content":[{{"type":"image_url","image_url":{{"url":' || {duck.json("'data:image/jpeg;base64,' || to_base64(encode(text))")} || '}}}},{{"type":"text","text":' || {duck.json(duck.filled(PROMPT_SHORT, question="text"))} || '}}]}}]' AS messages FROM documents"""
)
def chat_messages(spark, sf_dir):
    uri = media.data_uri(F.encode("text", "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(ingest.chat_messages(F.col("text"), uri, PROMPT_SHORT)).alias("messages"))


@query("SELECT conv_id, turn, text AS completion FROM conversations")
def completion_text(spark, sf_dir):
    """Completions of user turns as strings, of others as messages, the first of which counts."""
    plain = F.when(F.col("role") == "user", F.col("text"))
    messages = F.when(F.col("role") != "user", F.array(F.struct("role", F.col("text").alias("content")), F.struct("role", F.lit("later").alias("content"))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", metrics.completion_text(plain, messages).alias("completion"))


@query(f"WITH {PREDICTIONS}, s AS (SELECT CAST(doc_id AS VARCHAR) AS qid, text AS question, 0 AS later FROM documents UNION ALL SELECT CAST(doc_id AS VARCHAR), 'again ' || source, 1 FROM documents WHERE lang = 'en') SELECT run_id, qid, arg_max(question, later) AS question FROM predictions JOIN s USING (qid) GROUP BY run_id, qid")
def question_join(spark, sf_dir):
    """Predictions with their subset's questions; of a qid that the subset repeats the last row counts."""
    d = table(spark, sf_dir, "documents").withColumn("qid", F.col("doc_id").cast("string"))
    again = d.where("lang = 'en'").select("qid", F.concat(F.lit("again "), "source").alias("question"), F.lit(1).alias("later"))
    subset = d.select("qid", F.col("text").alias("question"), F.lit(0).alias("later")).unionByName(again)
    return tables.looked_up(predictions(spark, sf_dir).select("run_id", "qid"), "qid", subset, "qid", F.col("later")).select("run_id", "qid", "question")


@query("SELECT o_orderkey, arg_max(image, later) AS image FROM orders JOIN (SELECT c_custkey AS k, c_name AS image, 0 AS later FROM customer UNION ALL SELECT c_custkey, c_mktsegment, 1 FROM customer WHERE c_acctbal < 0) ON o_custkey = k GROUP BY o_orderkey")
def payload_join_last_wins(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    later = customers.where("c_acctbal < 0").select("c_custkey", F.col("c_mktsegment").alias("image"), F.lit(1).alias("later"))
    images = customers.select("c_custkey", F.col("c_name").alias("image"), F.lit(0).alias("later")).unionByName(later)
    return tables.payloads(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", images, "c_custkey", F.col("later")).select("o_orderkey", "image")


@query(f"WITH {COMPLETIONS} SELECT conv_id, turn, 'It has ' || CAST(len(question) AS VARCHAR) || '. <answer>' || split_part(question, ' ', 1) || '</answer>' AS raw FROM completions")
def generate_from_provider(spark, sf_dir):
    """A stand-in model, which gets the questions of so many rows at once and answers each with its first word."""

    def answer(rows):
        said = [None if q is None else f"It has {len(q)}. <answer>{q.split(' ', 1)[0]}</answer>" for q in rows["question"]]
        return rows[["conv_id", "turn"]].assign(raw=said)

    return ingest.generate(completions(spark, sf_dir).select("conv_id", "turn", "question"), "conv_id long, turn long, raw string", answer)


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority LIKE '1%'")
def semi_join_payloads(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").where("o_orderpriority LIKE '1%'").select("o_orderkey", "o_custkey")
    images = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return tables.payloads(asked, "o_custkey", images, "c_custkey").select("o_orderkey", "c_name")


@query("""SELECT doc_id, '{"doc_id":' || CAST(doc_id AS VARCHAR) || ',"lang":"' || lang || '","limit":null}' AS document FROM documents""")
def json_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", files.document("doc_id", "lang", F.lit(None).cast("int").alias("limit")).alias("document"))
