"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import pytest
from pyspark.sql import functions as F

from hapforge.llm import exact_dedup, fingerprints, masked_lm, mixing, near_dup, packing, preferences, quality, toxicity, url_rules

LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [
    (1, "a b c d e f", "en", "s1", 11), (2, "a b c d e f", "en", "s1", 11), (2, "a b c d e f", "en", "s1", 11), (3, None, None, None, None), (4, "", "en", "s2", 0), (5, " \n\t ", "en", "s2", 3),
    (None, "lonely words here", "en", None, 17), (6, LONG, "en", "s1", len(LONG)), (7, "Ünï日本 ß 😀 é", "de", "s3", 5), (8, "a b", "en", "s1", 3), (9, "x" * 5000, "en", "s1", 5000),
]
CLASH = ("digest", "locator", "node", "lanes", "range", "guard", "keep_id", "kept", "score", "x", "label", "src", "block", "epoch", "length", "piece", "start", "at", "part", "component_id", "host", "rule", "turns", "n")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None), (4, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")


def test_exact_dedup(docs, none):
    got = sorted([tuple(r)[:4] for r in exact_dedup.exact_dedup(docs).collect()], key=repr)
    by = {}
    for doc_id, keep, size, kept in got:
        by.setdefault(doc_id, []).append((keep, size, kept))
    assert by[1] == [(2, 3, False)] and sorted(by[2]) == [(2, 3, False), (2, 3, True)]
    assert by[3] == [(4, 2, False)] and by[4] == [(4, 2, True)] and by[None] == [(None, 1, True)]
    kept = exact_dedup.keep_first_copies(docs)
    assert kept.columns == docs.columns and kept.count() == 8
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.keep_first_copies(none).count() == 0


@pytest.mark.parametrize("hot_keys", [2, 5, exact_dedup.HOT_KEYS])
def test_exact_dedup_hot_digests(spark, monkeypatch, hot_keys):
    """60 rows of one text, 25 of a second, 2 of a third, 13 single ones; one, two or all three groups are hot."""
    monkeypatch.setattr(exact_dedup, "HOT_KEYS", hot_keys)
    texts = ["a"] * 60 + [None, ""] * 12 + [""] + ["c", "c"] + [f"single {i}" for i in range(13)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect()}
    groups: dict[str, list[int]] = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    assert got == {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}
    assert sorted(r.doc_id for r in exact_dedup.keep_first_copies(df).collect()) == sorted(map(max, groups.values()))


def test_exact_dedup_compares_bytes(spark):
    """A digest that is far too short: texts must still be told apart."""
    rows = [(i, t) for i, t in enumerate(["aa", "bb", "aa", "cc", "bb", "dd", "aa"])] + [(2, "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    short = lambda c: F.substring(F.sha2(c, 256), 1, 0)
    got = exact_dedup.exact_dedup(df, digest=short)
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got.collect()} == {(0, 6, 4), (2, 6, 4), (6, 6, 4), (1, 4, 2), (4, 4, 2), (3, 3, 1), (5, 5, 1)}
    assert got.where("kept").count() == 4


def test_stream_in_several_batches(spark):
    df = spark.createDataFrame([(i, f"t{i % 3}") for i in range(20)], "doc_id long, text string").repartition(5)
    assert {(r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(df, files_per_batch=1).collect()} == {(18, 7), (19, 7), (17, 6)}


def test_fingerprints(docs, none):
    rows = fingerprints.edit_sensitivity(docs).collect()
    assert len(rows) == len(ROWS) and all(r.near_edited in (0.0, 1.0) for r in rows)
    assert fingerprints.edit_sensitivity(none).count() == 0 and fingerprints.fingerprint(none).count() == 0
    prints = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(docs).collect()}
    assert prints[1] == prints[2] and prints[3] == prints[4] == prints[5] and prints[1] != prints[8]


def test_near_dup(docs, none):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()}
    assert (1, 2, 1, True) in got and (2, 2, 1, False) in got and (3, 0, 3, True) in got and (5, 0, 5, True) in got and (8, 1, 8, True) in got and (None, 1, None, True) in got
    assert near_dup.near_duplicates(none).count() == 0
    assert near_dup.keep_representatives(docs).columns == docs.columns and near_dup.keep_representatives(docs).count() == len(ROWS) - 2


def test_mixing(docs, none):
    got = mixing.draw(docs, repeat_limit=3.0)
    assert {r.doc_id for r in got.collect()} == {r[0] for r in ROWS}
    out = mixing.mix(docs, repeat_limit=3.0)
    assert out.columns == docs.columns and out.count() >= len(ROWS)
    assert mixing.draw(none).count() == 0 and mixing.mix(none).count() == 0
    assert mixing.draw(docs.where("text IS NULL OR text = ''")).count() == 2


def test_packing(docs, none):
    rows = packing.pack_documents(docs).collect()
    assert {r.doc_id for r in rows} == {r[0] for r in ROWS}
    assert [r.length for r in rows if r.doc_id in (3, 4, 5)] == [1, 1, 1]
    assert packing.pack_documents(none).count() == 0


def test_classifiers(docs, none, labels):
    for f in (quality.quality_scores, toxicity.toxicity_scores):
        rows = f(docs, labels).collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
        assert f(none, labels).count() == 0
        assert f(docs, labels.where("false")).count() == len(ROWS)
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_masked_lm(docs, none):
    rows = {r.doc_id: r for r in masked_lm.masked_lm_scores(docs).collect()}
    assert rows[3].n_tokens == 0 and rows[3].sum_logprob == 0 and rows[3].mean_logprob is None
    assert rows[6].n_tokens == 30_000 and rows[6].sum_logprob < 0
    assert masked_lm.masked_lm_scores(none).count() == 0


def test_urls(spark):
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (2, "no scheme"), (None, "http://EXAMPLE.com/en/x?y#z"), (3, "http://x.net"), (4, "")], "page_id long, url string").withColumn("host", F.lit("clash"))
    empty = spark.createDataFrame([], "url string, bad boolean")
    rules = (("block", "example.com/en/"), ("allow", "com/"))
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(pages, empty, rules).collect()}
    assert got == {(1, "", "", None, "allow"), (2, "", "", None, "allow"), (None, "example.com", "/en/x", "example.com/en/", "block"), (3, "x.net", "", None, "allow"), (4, "", "", None, "allow")}
    assert url_rules.judge_urls(pages.where("false"), empty).count() == 0


def test_preferences(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 1, "assistant", "a"), (1, 0, "user", "q"), (1, 1, "assistant", "b"), (2, None, None, None), (None, 0, "user", "x"), (4, 0, "assistant", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))
    got = {r.conv_id: r for r in preferences.preference_rows(df).collect()}
    assert got[0].prompt == "<|user|>\nq<|end|>\n" and got[0].chosen_completion == "<|assistant|>\na<|end|>\n" and got[0].rejected_completion == "<|assistant|>\nb<|end|>\n"
    start, end = got[0].chosen_mask[0]
    assert got[0].chosen_completion[start:end] == "a<|end|>\n"
    # Without an answer the whole conversation is prompt; no turn is left out.
    assert got[2].prompt == "<||>\n<|end|>\n" and got[2].chosen_mask == got[2].rejected_mask == [] and got[2].chosen_completion == ""
    assert got[None].n_prompt_turns == 1 and got[None].prompt == "<|user|>\nx<|end|>\n"
    assert got[4].prompt == got[4].rejected_completion == "" and got[4].chosen_completion == "<|assistant|>\nonly<|end|>\n"
    assert preferences.preference_rows(df.where("false")).count() == 0


def test_stages_drop_rows_not_identifiers(spark, monkeypatch):
    """Rows that share a null or repeated identifier with a rejected one stay."""
    base = " ".join(f"word{i}" for i in range(60))
    clean = [(None, "quiet lake at dawn with birds"), (None, "a second unrelated text about bread"), (5, "roads and bridges of the north"), (5, "third text on clouds")]
    near = [(None, base + " end"), (5, base + " fin"), (1, base), (None, "only nulls " + base.upper()[::-1]), (None, "only nulls " + base.upper()[::-1] + " x")]
    df = spark.createDataFrame(clean + near, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in near_dup.keep_representatives(df).collect()]
    rest = [r for r in got if r not in clean]
    assert set(clean) <= set(got) and len(got) == len(clean) + 2 and (1, base) in rest and any(t.startswith("only nulls") for _, t in rest)

    class Rejects:
        def probability(self, x):
            return (x[:, toxicity.FEATURES.index("shout_share")] > 0).astype(float)

    monkeypatch.setattr(toxicity, "fit", lambda rows: Rejects())
    toxic = [(None, "bad!!!"), (5, "worse!!!")]
    labels = spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int")
    kept = toxicity.drop_toxic(spark.createDataFrame(clean + toxic, "doc_id long, text string"), labels)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(clean, key=repr)
