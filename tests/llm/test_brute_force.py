"""Operators held against plain recomputation."""

import math
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hapforge.llm import fingerprints, masked_lm, mixing, near_dup, packing, preferences, queries, toxicity, url_rules
from hapforge.llm.labelled import isotonic

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


# --- near-duplicates ---------------------------------------------------------------------------


def shingles(text, k):
    w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in text.encode().split()]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def linked(texts, k, percent):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            both = len(sets[i] & sets[j])
            if both and both * 100 >= percent * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_dup_equals_all_pairs(docs, texts, k, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, k=k, percent=percent).collect()}
    assert got == linked(texts, k, percent)


def test_near_dup_chains_and_large_groups(spark):
    """Copies that drift away step by step: neighbours are linked, the ends aren't; and a large group around one text."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    base = list(rng.choice(words, 120))
    chain, now = [], list(base)
    for _ in range(25):
        now = list(now)
        for at in rng.integers(0, len(now), 2):
            now[at] = f"n{rng.integers(1_000_000)}"
        chain.append(" ".join(now))
    group = []
    for _ in range(150):
        t = list(base)
        for at in rng.integers(0, len(t), rng.integers(0, 6)):
            t[at] = f"m{rng.integers(1_000_000)}"
        group.append(" ".join(t))
    other = [" ".join(rng.choice(words, 60)) for _ in range(40)]
    texts = dict(enumerate(chain + group + other + group[:30]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, k=3, percent=85).collect()}
    assert got == linked(texts, 3, 85)


def test_bitmaps_never_differ_more_than_sets():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 900).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, n)) for n in (1, 5, 60, 200, 700)] + [pool[:100], np.concatenate([pool[:90], pool[500:510]])]
    bits = np.unpackbits(near_dup.parity_bitmaps(np.concatenate(sets), np.array([len(s) for s in sets])).view(np.uint8), axis=1)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert (bits[i] != bits[j]).sum() <= len(np.setxor1d(a, b)) and (i != j or (bits[i] == bits[j]).all())


def test_bands_follow_the_threshold():
    for percent in (80, 85):
        b = near_dup.bands_for(percent)
        assert (1 - (percent / 100) ** near_dup.ROWS) ** b <= near_dup.MISS


# --- packing -----------------------------------------------------------------------------------


def test_packing_equals_the_tokenizer(docs, texts):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.tokenizer_path())
    want = set()
    for i, t in texts.items():
        ids = [*tk.encode(t, add_special_tokens=False).ids, 1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            want.add((i, p, at, len(part), zlib.crc32(part.tobytes())))
    rows = packing.pack_documents(docs).collect()
    assert {tuple(r)[:5] for r in rows} == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


@pytest.mark.parametrize("text", ["", "it's I'M don'T we'LL x''s'", "Ünï ÇA ÿ ß × é İstanbul ΑΣ σας 日本 １２ ½ ª µ", "a\x1cb\x85c\xa0d \x0b e f", "12,5€ 3.14", "\x00\x01 \x7f don’t 're"])
def test_run_memo_equals_the_tokenizer(text):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(packing.tokenizer_path())
    assert packing.word_ids(packing.tokenizer_path()).encode(text) == np.array(tk.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=25))
def test_rounds_place_every_piece_once(counts):
    plan = packing.sweep_rounds(counts, 64)
    fill, seen = defaultdict(list), Counter()
    for length, rank, n, first, per, offset in plan.tolist():
        for k in range(n):
            seen[length, rank + k] += 1
            fill[first + k // per].append((offset + k % per * length, length))
    assert seen == Counter({(length, r): 1 for length, c in counts.items() for r in range(c)})
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    gaps = []  # one piece after the other, longest first, each into the smallest gap that holds it
    for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        best = min((i for i, g in enumerate(gaps) if g >= length), key=lambda i: gaps[i], default=None)
        if best is None:
            gaps.append(64 - length)
        else:
            gaps[best] -= length
    assert len(fill) <= math.ceil(len(gaps) * 1.1) + 1


# --- fingerprints ------------------------------------------------------------------------------


def folded(text):
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def test_fingerprints_equal_where_folded_texts_are(docs, texts):
    import hashlib

    rows = {r.doc_id: r for r in fingerprints.edit_sensitivity(docs).collect()}
    ids = sorted(texts)
    prints = {}
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        t, n = texts[a], texts[b]
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        r = rows[a]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.near_edited == 1) == (folded(edited) == folded(t)) and (r.near_next == 1) == (folded(n) == folded(t))
        prints.setdefault(folded(t), set()).add(r.fingerprint)
        prints.setdefault(folded(edited), set()).add(r.edited_fingerprint)
    assert all(len(p) == 1 for p in prints.values()) and len(set().union(*prints.values())) == len(prints)


def test_equal_lanes_are_told_apart_by_bytes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "A "), (3, "b"), (4, "c"), (5, "b")], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(df, hashed=lambda c: F.lit("same")).collect()}
    assert got[1] == got[2] and got[3] == got[5] and len(set(got.values())) == 3


@pytest.mark.parametrize("hashed", [fingerprints.lanes_of, lambda c: F.lit("same"), lambda c: (F.length(c) % 2).cast("string")])
def test_edited_texts_are_told_apart_by_bytes(spark, hashed):
    rows = ["abcd", "abxy", "abxy", "ABXY", "q", "", "  z  z", "cdzz", "abab", "ab"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    prints = {}
    got = fingerprints.edit_sensitivity(df, hashed=hashed).collect()
    assert len(got) == len(rows)
    for r in got:
        t, n = rows[r.doc_id], rows[(r.doc_id + 1) % len(rows)]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        prints.setdefault(folded(t), set()).add(r.fingerprint)
        prints.setdefault(folded(edited), set()).add(r.edited_fingerprint)
        assert (r.near_edited == 1) == (folded(edited) == folded(t)) and (r.near_next == 1) == (folded(n) == folded(t))
    assert all(len(p) == 1 for p in prints.values()) and len(set().union(*prints.values())) == len(prints)


def test_rows_that_share_an_identifier_have_one_order(spark):
    rows = [(1, "one"), (1, "two"), (1, None), (1, "two"), (None, "three"), (2, "four")]
    results = set()
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        results.add(tuple(sorted((r.doc_id or 0, r.n_chars, r.edited_sha256, r.near_next) for r in fingerprints.edit_sensitivity(df).collect())))
    assert len(results) == 1 and len(results.pop()) == len(rows)


@pytest.mark.parametrize("a, b", [("ﬁne", "FINE"), ("Straße", "STRASSE"), ("é", "é"), ("a \n b", "A B"), ("ｆｕｌｌ", "full")])
def test_folding(spark, a, b):
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert len({r.fingerprint for r in fingerprints.fingerprint(df).collect()}) == 1


# --- mixing ------------------------------------------------------------------------------------


def mixture(spark):
    rows = [(i, "w " * (5 + i % 7), "big" if i % 3 else f"s{i % 5}") for i in range(4000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_weights_meet_the_limit_and_the_budget(spark):
    df = mixture(spark)
    got = mixing.draw(df, repeat_limit=2.0, budget_share=1.0).groupBy("source").agg(F.sum("n_tokens").alias("t"), F.max("epoch").alias("e")).collect()
    own = {r.source: r.t for r in df.groupBy("source").agg(F.sum(mixing.count_words(F.col("text"))).alias("t")).collect()}
    total = sum(own.values())
    assert abs(sum(r.t for r in got) - total) < 0.01 * total
    rate = {r.source: r.t / own[r.source] for r in got}
    assert max(rate.values()) <= 2.0 + 1e-6 and max(rate.values()) > 1.9 and rate["big"] < 1


def test_entropy_target(spark):
    df = mixture(spark)
    units = df.select(F.concat(F.lit("s"), "source").alias("src"), mixing.count_words(F.col("text")).alias("n_tokens"))
    shares = mixing.source_shares(units)
    p = np.array([r.tokens for r in shares.collect()], float)
    p /= p.sum()
    wanted = 1.6
    t, z, _ = mixing.bisect_exponent(shares, wanted, None, None)
    w = p**t / z
    assert abs(-(w * np.log(w)).sum() - wanted) < 1e-5


def test_every_epoch_is_a_permutation(spark):
    df = mixture(spark)
    rows = mixing.draw(df, repeat_limit=2.5, block_rows=50).collect()
    own = {r.doc_id: r.source for r in df.collect()}
    whole = Counter(own.values())
    per = defaultdict(list)
    for r in rows:
        per[r.source, r.epoch].append((r.block_rank, r.place, r.doc_id))
    for (source, epoch), drawn in per.items():
        assert len({d for _, _, d in drawn}) == len(drawn) and len({d[:2] for d in drawn}) == len(drawn)
        if (source, epoch + 1) in per:
            assert len(drawn) == whole[source]
    a, b = ([d for *_, d in sorted(per["s0", e])] for e in (0, 1))
    assert a != b[: len(a)]
    assert {r.doc_id for r in rows} == set(own)


# --- models ------------------------------------------------------------------------------------


def auc(score, label):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1.0
    for s in np.unique(score):
        order[score == s] = order[score == s].mean()
    n1, n0 = label.sum(), (1 - label).sum()
    return (order[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


@pytest.mark.parametrize("name, column, threshold, least", [("op3_quality", "quality", 0.3, 0.93), ("op7_toxicity", "toxic", 0.5, 0.93)])
def test_held_out_accuracy(spark, name, column, threshold, least):
    sf = "/root/testdata/sf0.1"
    rows = queries.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert all(rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id])
    assert all(rows.predicted == (rows.score >= threshold))
    held = rows[rows.held_out]
    assert auc(held.score.to_numpy(), held[column].to_numpy()) > least
    assert (held.predicted == held[column]).mean() > 0.95


def test_isotonic_rises():
    rng = np.random.default_rng(0)
    x = rng.random(500)
    knots = isotonic(x, (rng.random(500) < x).astype(float))
    assert (np.diff(knots[1]) >= 0).all() and abs(np.interp(0.5, *knots) - 0.5) < 0.15


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = toxicity.BoostedTrees().fit(x[:1500], y[:1500])
    assert ((model.raw(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.95


def test_obfuscated_words_are_read():
    lexicon = toxicity.Lexicon({"=idiot": 3.0})
    f = dict(zip(toxicity.FEATURES, toxicity.features("you 1d!ot are an id1ot", lexicon), strict=True))
    assert f["obfuscated_hits"] == 1 and f["obfuscated_share"] > 0
    assert dict(zip(toxicity.FEATURES, toxicity.features("you idiot", lexicon), strict=True))["near_second"] == 1


def test_masked_lm_sums_whole_texts(spark, docs, texts):
    """Scores are sums over all words of a table that is a distribution for each pair of neighbours."""
    network = masked_lm.WindowNetwork()
    rng = np.random.default_rng(0)
    losses = network.train(rng.poisson(0.2, masked_lm.CONTEXTS**2 * masked_lm.OUTPUTS).astype(float), 25)
    assert losses[-1] < losses[0]
    table = network.table()
    assert np.allclose(np.exp(table.reshape(-1, masked_lm.OUTPUTS)).sum(1), 1, atol=1e-3)
    rows = {r.doc_id: r for r in masked_lm.masked_lm_scores(docs).collect()}
    assert all(rows[i].n_tokens == len(masked_lm.words_of(t)) and rows[i].sum_logprob <= 0 for i, t in texts.items())
    triples = {r.cell: r.n for r in masked_lm.triple_counts(docs.select("text"), [b"the", b"of"]).collect()}
    want = Counter()
    for t in texts.values():
        want.update(masked_lm.cells(masked_lm.Vocabulary([b"the", b"of"]).outputs(t)).tolist())
    assert triples == dict(want)


def test_masked_lm_prefers_order():
    """Words in the order of the corpus are likelier than shuffled ones."""
    voc = masked_lm.Vocabulary([b"a", b"b", b"c"])
    counts = np.zeros(masked_lm.CONTEXTS**2 * masked_lm.OUTPUTS)
    np.add.at(counts, masked_lm.cells(voc.outputs("a b c " * 200)), 1)
    network = masked_lm.WindowNetwork()
    network.train(counts, 120)
    score = lambda t: network.table()[masked_lm.cells(voc.outputs(t))].sum()
    assert score("a b c a b c") > score("c b a b a c")


def test_special_tokens_inside_a_text_are_single_ids():
    from tokenizers import Tokenizer

    plain, ids = Tokenizer.from_file(packing.tokenizer_path()), packing.word_ids(packing.tokenizer_path())
    for text in ("a<|endoftext|>b", "<|startoftext|> Hello <|endoftext|>", "<|ENDOFTEXT|> é 日本\u00a0x <|endoftext|>", "<|endoftext|", "oftext|> y"):
        assert ids.encode(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert np.frombuffer(ids.encode("<|startoftext|><|endoftext|>"), "<u4").tolist() == [49406, 49407]


@pytest.mark.parametrize("head", [masked_lm.HEAD, 450, 0])
def test_masked_lm_tells_words_of_a_bucket_apart(spark, monkeypatch, head):
    """Words outside the listed ones are scored by their own counts, broadcast or joined, and all words together are a distribution."""
    monkeypatch.setattr(masked_lm, "HEAD", head)
    bucket = lambda w: zlib.crc32(w.encode()) % masked_lm.BUCKETS
    same = [w for i in range(1000) if bucket(w := f"rare{i}") == bucket("rare0")][:3]
    listed = [f"often{i}" for i in range(masked_lm.WORDS)]
    texts = [w for w in listed for _ in range(9)] + [same[0]] * 5 + [same[1]] * 2 + [same[2]] + [f"once{i}" for i in range(700)]
    df = spark.createDataFrame([(7, t) for t in texts] + [(8, f"{same[0]} {same[2]} often1 {same[2]}")], "doc_id long, text string")
    scored = masked_lm.masked_lm_scores(df.withColumn("doc_id", F.when(F.col("doc_id") == 7, F.xxhash64("text")).otherwise(8)))
    ids = {r.h: r.text for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    rows = [(ids.get(r.doc_id), r.sum_logprob) for r in scored.collect()]
    assert len(rows) == len(texts) + 1
    got = dict(rows)
    assert got[same[0]] - got[same[1]] == pytest.approx(np.log(6 / 2)) and got[same[0]] - got[same[2]] == pytest.approx(np.log(6 / 3))
    by_word = {t: p for t, p in rows if t is not None and " " not in t}
    assert len(by_word) == masked_lm.WORDS + 703 and sum(np.exp(p) for p in by_word.values()) == pytest.approx(1, abs=0.01)


# --- urls and preferences ----------------------------------------------------------------------


def test_rules_are_mined_and_matched(spark):
    good = [(f"https://www.site{i}.example.org/en/{i}", False) for i in range(200)]
    bad = [(f"http://m.cheap-pills{i % 4}.example.com/buy/{i}?ref=x", True) for i in range(60)]
    labelled = spark.createDataFrame(good + bad, "url string, bad boolean")
    rules = url_rules.mine(labelled)
    assert rules and all(c >= url_rules.LIFT * 60 / 260 for _, c in rules)
    brute = lambda tokens: any(r <= set(tokens) for r, _ in rules)
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(good + bad)] + [(999, "http://new.example.com/buy/7?ref=q")], "page_id long, url string")
    tokens = {r.page_id: r.t for r in pages.select("page_id", url_rules.tokens_of(F.col("url")).alias("t")).collect()}
    got = {r.page_id: r.verdict for r in url_rules.judge_urls(pages, labelled).collect()}
    assert got == {i: "block" if brute(t) else "allow" for i, t in tokens.items()}
    assert got[0] == "allow" and got[210] == "block" and got[999] == "block"


def test_mining_has_one_floor_at_every_size_and_no_limit_on_tokens(spark):
    """Eight bad urls are enough among 40 and among 4,000; seven never are; and a rule may need four tokens."""
    spread = [(f"https://h{i}.example.org/p{chr(97 + i % 26)}/", i % 10 == 0) for i in range(4000)]
    for rest in (spread[:32], spread):
        for n, found in ((8, True), (7, False)):
            rules = url_rules.mine(spark.createDataFrame(rest + [("http://few.example.net/z/", True)] * n, "url string, bad boolean"))
            assert any("host=few" in r for r, _ in rules) == found
    parts = [(a, b, c, d) for a in "xy" for b in "xy" for c in "xy" for d in "xy"]
    urls = [(f"http://a{a}.b{b}.c{c}.org/d{d}", (a + b + c + d) == "xxxx") for a, b, c, d in parts for _ in range(12)]
    rules = url_rules.mine(spark.createDataFrame(urls, "url string, bad boolean"))
    assert (frozenset(("host=ax", "host=bx", "host=cx", "path=dx")), 1.0) in rules


def test_listed_rules_on_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in queries.op2_url_filter(spark, SF).collect()}
    for r in pages.select("page_id", "url").collect():
        rest = r.url.partition("://")[2]
        end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0], default=len(tail))]
        fits = [(w, t) for w, t in queries.RULES if (host == t.partition("/")[0] or host.endswith("." + t.partition("/")[0])) and path.startswith("/" + t.partition("/")[2])]
        want = max(fits, key=lambda f: len(f[1]), default=(None, None))
        assert (got[r.page_id].host, got[r.page_id].path, got[r.page_id].rule) == (host, path, want[1])
        assert want[0] is None or got[r.page_id].verdict == want[0]


def test_common_turns_end_at_the_first_difference(spark):
    t = lambda *xs: [(i, r, x) for i, (r, x) in enumerate(xs)]
    a = t(("system", "s"), ("user", "u"), ("assistant", "x"), ("user", "v"), ("assistant", "y"))
    b = t(("system", "s"), ("user", "u"), ("assistant", "z"))
    df = spark.createDataFrame([(1, a, b), (2, a, a), (3, [], b), (4, b[:2], a)], f"id long, chosen array<{preferences.TURN}>, rejected array<{preferences.TURN}>")
    got = {r.id: r for r in preferences.format_pairs(df).collect()}
    assert [got[i].n_prompt_turns for i in (1, 2, 3, 4)] == [2, 5, 0, 2]
    spans = [got[1].chosen_completion[s:e] for s, e in got[1].chosen_mask]
    assert spans == ["x<|end|>\n", "y<|end|>\n"] and got[2].chosen_completion == "" and got[4].chosen_completion == ""


def test_no_turn_of_a_conversation_is_left_out(spark):
    rows = [(0, 0, "user", "a"), (0, 1, "assistant", "b"), (0, 2, "user", "c"), (0, 3, "assistant", "d"), (0, 4, "user", "e"), (1, 0, "user", "a"), (1, 1, "assistant", "z"), (1, 2, "user", "y"), (2, 0, "user", "only"), (3, 0, "user", "u"), (3, 1, "assistant", "v" * 50_000)]
    out = preferences.preference_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in out.collect()}
    for i in range(4):
        whole = "".join(f"<|{r}|>\n{t}<|end|>\n" for c, _, r, t in rows if c == i)
        assert got[i].prompt + got[i].chosen_completion == whole
    assert [got[i].n_prompt_turns for i in range(4)] == [1, 1, 1, 1]
    assert [got[0].chosen_completion[s:e] for s, e in got[0].chosen_mask] == ["b<|end|>\n", "d<|end|>\n"]
    assert got[0].rejected_completion == "<|assistant|>\nz<|end|>\n<|user|>\ny<|end|>\n" and got[2].chosen_completion == got[2].rejected_completion == got[3].rejected_completion == ""


# --- SQL and the pipeline ----------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_statement(spark, name):
    import sys
    from pathlib import Path

    import duckdb

    sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
    import compare

    con = duckdb.connect()
    for t in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {t.stem} AS SELECT * FROM read_parquet('{t}')")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    assert compare.canonical(got) == compare.canonical(want)


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]
    now, seen = docs, {r.doc_id for r in docs.select("doc_id").collect()}
    for i, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, now, SF)
        if i + 1 < len(p.STAGES):
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / str(i)))
            out = spark.read.parquet(str(tmp_path / str(i)))
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept <= seen
        if name == "exact dedup":
            assert out.count() == now.select("text").distinct().count()
        if name == "near dedup":
            texts = {r.doc_id: r.text for r in now.collect()}
            assert kept == {i for i, (_, c) in linked(texts, 5, 80).items() if i == c}
        if name in ("mixing", "packing"):
            assert kept == seen
        seen, now = kept, out
    assert p.run(spark, SF).count() > 0
