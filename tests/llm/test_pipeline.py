"""The pipeline against plain versions of its stages."""

import os
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from answerloom.llm import packing, quality
from answerloom.llm.common import held_out, materialize, scope, shared_dir, table
from tests_llm_plain import contaminated, groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = [table(spark, SF, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(materialize(stage(spark, docs[-1], SF)))
    return docs


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_all_but_the_last_keep_the_columns(steps):
    assert all(sorted(d.columns) == sorted(steps[0].columns) for d in steps[:-1])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]


def test_quality_keeps_good_and_drops_bad(spark, steps):
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    before, after = ids(steps[0]), ids(steps[1])
    good = [d for d in before if labels.get(d) == 1]
    bad = [d for d in before if labels.get(d) == 0]
    assert sum(d in after for d in good) >= 0.97 * len(good) and sum(d in after for d in bad) <= 0.2 * len(bad)
    model = quality.fit(steps[0], table(spark, SF, "labels"))
    scored = quality.score(spark, steps[0], model)
    assert after == ids(scored.where("score >= 0.5"))


def test_language_drops_only_texts_without_letters(steps):
    kept = ids(steps[2])
    for r in steps[1].collect():
        assert (r.doc_id in kept) == any(c.isalpha() for c in r.text or "")


def test_one_of_each_group_stays(steps):
    rows = sorted(steps[2].select("doc_id", "text").collect())
    found = groups([r.text for r in rows], 5, 8, 10)
    assert ids(steps[3]) == {rows[i].doc_id for i, (_, root) in found.items() if root == i}


def test_contaminated_documents_go(spark, steps):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert ids(steps[4]) == {r.doc_id for r in steps[3].collect() if not contaminated(r.text, items)[1]}


def test_every_word_is_packed(steps):
    words = steps[4].select(F.sum(packing.n_words(F.col("text")))).first()[0]
    assert steps[5].agg(F.sum("n_tokens")).first()[0] == words and ids(steps[5]) == ids(steps[4])


def test_run_is_the_stages(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert got.exceptAll(steps[5].select(got.columns)).count() == 0 and got.count() == steps[5].count()


def test_repeats_and_nulls_pass_through_deduplication(spark):
    rows = [(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "a b c d e f", None, "s", None), (3, None, None, None, None), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == [1, 3, 4]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(name, n=30):
    return " ".join(f"{name}{i}" for i in range(n))


def test_deduplication_is_by_row(spark):
    """Null ids, and ids that stand on two texts, which are each the only ones, the least ones or copies."""
    pairs = [
        (None, words("a")), (None, words("a")), (None, words("b")), (9, words("b")),  # only null ids; a null id beside another
        (1, words("c")), (1, words("d")), (2, words("c")), (2, words("d")),  # one id is the least of two groups
        (5, words("c")), (5, words("e")),  # one text is a copy of a lesser id's, the other clean
        (None, words("f") + " x"), (None, words("f") + " y"), (None, None), (7, ""), (7, " "),
    ]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in pairs], SCHEMA)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert len([t for _, t in kept if t and t.startswith("f0 ")]) == 1
    clean = [(None, words("a")), (9, words("b")), (1, words("c")), (1, words("d")), (5, words("e")), (None, None), (7, ""), (7, " ")]
    assert sorted(map(str, kept)) == sorted(map(str, clean + [x for x in kept if x[1] and x[1].startswith("f0 ")]))


def test_decontamination_is_by_row(spark):
    item = next(r.text for r in table(spark, SF, "benchmark").orderBy("item_id").collect() if len(r.text.split()) >= 12)
    pairs = [(None, item), (None, words("a")), (1, item), (1, words("b")), (1, words("b")), (2, words("c")), (None, None), (3, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in pairs], SCHEMA)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.benchmark_decontamination(spark, docs, SF).collect()]
    assert sorted(map(str, kept)) == sorted(str(p) for p in pairs if p[1] != item)


def test_unlearnt_languages_and_letter_noise_go(spark):
    """Planted texts go; what has letters stays, held-out documents included."""
    rng = random.Random(5)
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)) for n in (12, 40, 300)]
    unlearnt = [
        "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto",
        "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem",
        "watu wote wamezaliwa huru hadhi na haki zao ni sawa wote wamejaliwa akili na dhamiri hivyo yapasa watendeane kindugu",
    ]
    planted = spark.createDataFrame([(-i, t, None, "s", 0) for i, t in enumerate(noise + unlearnt, 1)], SCHEMA)
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    docs = docs.unionByName(planted.select([F.col(c).cast(t) for c, t in docs.dtypes]))
    kept = ids(corpus_pipeline.language_id(spark, docs, SF))
    assert kept == {r.doc_id for r in docs.collect() if r.doc_id >= 0 and any(c.isalpha() for c in r.text or "")}


def test_language_bounds_know_all_documents(spark):
    """Of a language's training documents two in a hundred are odd; none of these is among 500 chosen by the hash of their ids."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    hashes = spark.range(9_000).select("id", F.pmod(F.xxhash64("id"), F.lit(1_000_000)).alias("h"), held_out(F.col("id")).alias("out")).orderBy("id").collect()
    usable = [r for r in hashes if not r.out][:3_000]
    odd = {r.id for r in [r for r in usable if r.h > 400_000][:60]}
    texts = {r.id: "".join(rng.choice("zqxjkvbw ") for _ in range(200)) if r.id in odd else " ".join(rng.choices(vocabulary, k=40)) for r in usable}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], SCHEMA)
    kept = ids(corpus_pipeline.language_id(spark, docs, SF))
    assert len(odd & kept) >= 30 and len(kept - odd) >= 0.99 * len(texts.keys() - odd)


CLASHES = ["score", "Predicted", "_row", "row", "doc", "number", "key", "lang_pred", "length_class", "bound", "contaminated", "n_words", "n_tokens", "component_id"]


def clashing(docs):
    """The same rows with columns that have names which stages use, and one of a type that can't be compared."""
    return docs.select("*", *[F.col("doc_id").alias(c) for c in CLASHES], F.create_map(F.lit("k"), F.col("doc_id")).alias("place"))


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_of_any_name(spark, steps, k):
    out = corpus_pipeline.STAGES[k][1](spark, clashing(steps[k]), SF)
    assert out.columns == [*steps[k].columns, *CLASHES, "place"]
    rows = out.collect()
    assert all(r[c] == r.doc_id for r in rows for c in CLASHES) and all(r.place == {"k": r.doc_id} for r in rows)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in steps[k + 1].select("doc_id").collect())


@pytest.mark.parametrize("k", range(5))
def test_stages_take_empty_tables(spark, steps, k):
    out = corpus_pipeline.STAGES[k][1](spark, steps[k].limit(0), SF)
    assert out.count() == 0 and sorted(out.columns) == sorted(steps[k + 1].columns)


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows(spark, steps, k):
    """Null ids and texts, repeats, and very long texts beside ordinary rows."""
    rng = random.Random(k)
    long = " ".join(f"w{rng.randrange(900)}" for _ in range(120_000))
    pairs = [(None, None), (None, ""), (-1, None), (-2, long), (-2, long), (None, "a" * 300_000), (-3, "x"), (-3, "y")]
    odd = spark.createDataFrame([(d, t, None, None, None) for d, t in pairs], SCHEMA)
    docs = steps[k].unionByName(odd.select([F.col(c).cast(t) for c, t in steps[k].dtypes]))
    out = corpus_pipeline.STAGES[k][1](spark, docs, SF).select("doc_id").collect()
    assert {r.doc_id for r in out} >= ({r.doc_id for r in steps[k + 1].select("doc_id").collect()} if k > 1 else set())
    got = sorted((r.doc_id for r in out if r.doc_id is None or r.doc_id < 0), key=str)
    expected = {
        2: [-1, -2, -3, -3, None, None, None],  # of the two long copies one stays
        3: sorted((d for d, _ in pairs), key=str),
        4: sorted([*(d for d, _ in pairs), *[-2] * 2 * (120_000 // 4096)], key=str),
    }
    assert got == expected.get(k, got)


def test_language_stage_keeps_chosen_languages(spark, steps):
    docs = steps[1]
    kept = corpus_pipeline.language_id(spark, docs, SF, languages=["de"])
    everything = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, docs, SF).collect()}
    assert 0 < kept.count() < len(everything)
    assert all(r.lang in ("de", None) and r.doc_id in everything for r in kept.collect())


def test_what_stages_write_for_themselves_goes(spark):
    shared = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    with scope():
        assert corpus_pipeline.run(spark, SF).count() > 0
        assert 5 <= len(set(os.listdir(shared)) - before) <= 8  # four stages' results, and what the last one reads
    assert set(os.listdir(shared)) == before
