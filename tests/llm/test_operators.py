"""Each operator against brute force, a public library or an exact round trip,
on rows with nulls, empty and long texts, repeats and clashing column names."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def empty(docs):
    return docs.limit(0)


# ------------------------------------------------------------ 1 quality rules
def base(text):
    t = text or ""
    w = WORD.findall(t)
    g = Counter(zip(w, w[1:], w[2:]))
    hit = set()
    for i in range(len(w) - 2):
        if g[tuple(w[i:i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit),
            n < 50 or 100 * len(hit) > 50 * n)


def test_quality_metrics(docs, rows):
    from constella.llm.quality_rules import metrics

    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = {r["doc_id"]: tuple(r[c] for c in cols) for r in metrics(docs.withColumn("n_words", F.lit("x"))).collect()}
    assert got == {r[0]: base(r[1]) for r in rows}


def test_binomial_tail(spark):
    from constella.llm.quality_rules import binomial_tail

    def tail(n, k, p):
        return sum(math.comb(n, j) * p ** j * (1 - p) ** (n - j) for j in range(k + 1))

    cases = [(10, 0, .2), (500, 0, .01), (1000, 3, .01), (900, 40, .05), (1, 0, .01)]
    got = spark.range(1).select(*[binomial_tail(F.lit(n), F.lit(k), p) for n, k, p in cases]).first()
    assert np.allclose(list(got), [tail(*c) for c in cases], rtol=1e-7)


def test_thresholds_limit_false_rejection(spark):
    from constella.llm.quality_rules import judge

    clean = " ".join(f"word{i}" for i in range(60))
    junk = " ".join(f"word{i}####" for i in range(60))
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"),
                                 F.concat(F.when(F.col("id") % 10 == 0, junk).otherwise(clean), F.lit(" "), F.col("id")).alias("text"))
    labels = d.select("doc_id", (F.col("doc_id") % 10 != 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    kept = {r["doc_id"] for r in judge(d, labels).where("kept").collect()}
    assert kept == {i for i in range(4000) if i % 10}
    assert judge(empty(d), labels).count() == 0
    assert judge(d, empty(labels)).where("kept").count() == 4000


# --------------------------------------------------------------- 2 url filters
def test_url_rules_and_templates(spark):
    from constella.llm.url_templates import judge

    urls = [None, "no scheme", "http://net/x", "https://A.Example.NET/en/1?q", "http://b.example.net/de/1", "http://x.org/fr/",
            "http://x.org#frag", "http://example.com/de/1", "http://notexample.com/de/1", "ftp://h"]
    rows = list(enumerate(urls)) + [(100 + i, f"http://spam.io/buy/{i}") for i in range(200)]
    rows += [(400 + i, f"http://spam.io/news/{i}.html") for i in range(200)]
    pages = spark.createDataFrame([(a, b, "x") for a, b in rows], "page_id long, url string, host string")
    labels = spark.createDataFrame([(100 + i, 0) for i in range(100)] + [(400 + i, 1) for i in range(100)], "page_id long, good int")
    got = {r["page_id"]: r for r in judge(pages, labels).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(10)] == [
        ("", "", None), ("", "", None), ("net", "/x", "net/"), ("a.example.net", "/en/1", "example.net/en/"),
        ("b.example.net", "/de/1", "net/"), ("x.org", "/fr/", "org/fr/"), ("x.org", "", None),
        ("example.com", "/de/1", "example.com/de/"), ("notexample.com", "/de/1", None), ("h", "", None)]
    assert {got[i]["verdict"] for i in range(100, 300)} == {"block"} and {got[i]["verdict"] for i in range(400, 600)} == {"allow"}
    assert got[150]["template"] == "/buy/*"
    assert judge(empty(pages), labels).count() == 0
    assert {r["verdict"] for r in judge(pages, empty(labels)).where("rule is null").collect()} == {"allow"}


def test_url_heavy_section_among_many_small(spark):
    from constella.llm.url_templates import judge

    bad = [(i, f"http://shop.io/buy/{i}") for i in range(600)]
    small = [(1000 + i, f"http://shop.io/s{i % 60}/{i}") for i in range(600)]
    pages = spark.createDataFrame(bad + small, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 1000)) for i, _ in bad + small], "page_id long, good int")
    got = {r["page_id"]: (r["template"], r["verdict"]) for r in judge(pages, labels).collect()}
    assert {got[i] for i, _ in bad} == {("/buy/*", "block")}
    assert {got[i][1] for i, _ in small} == {"allow"} and {got[i][0][:2] for i, _ in small} == {"/*"}


# -------------------------------------------------------- 3 quality classifier
def test_classifier_held_out(spark):
    from constella.llm.ordinal_quality import classify, select

    import random

    r = random.Random(1)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(1200):
        w = [r.choice(vocab) for _ in range(r.randrange(3, 120))]
        kind = i % 6
        if kind == 0:
            w = [x.upper() + "!!" for x in w]
        if kind == 1:
            w.insert(r.randrange(len(w)), "scum")
        rows.append((i, " ".join(w), int(kind != 0), int(kind == 1)))
    d = spark.createDataFrame([(a, b) for a, b, _, _ in rows] + [(5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(a, q, t) for a, _, q, t in rows if a < 800], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in classify(d, labels).collect()}
    held = [x for x in rows if x[0] >= 800]
    assert np.mean([got[a]["kept"] == (q == 1 and t == 0) for a, _, q, t in held]) > 0.95
    assert all(g["p1"] >= g["p2"] for g in got.values())
    assert select(d, labels).columns == d.columns and select(empty(d), labels).count() == 0
    assert select(d, empty(labels)).count() == d.count()


# ------------------------------------------------------------- 4 token counts
def test_token_counts_equal_library(docs, rows):
    import public_tokenizers as P
    from tokenizers import Tokenizer, models, pre_tokenizers

    from constella.llm.token_counts import count_tokens, read_pieces

    path = P.path("piece_bpe_32k.model")
    tk = Tokenizer(models.Unigram(read_pieces(path), unk_id=0, byte_fallback=True))
    tk.pre_tokenizer = pre_tokenizers.Metaspace()
    got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(docs, path).collect()}
    assert got == {r[0]: len(tk.encode(r[1] or "", add_special_tokens=False).ids) for r in rows}
    assert count_tokens(empty(docs), path).count() == 0


# ----------------------------------------------------------------- 5 sharding
def test_flow_moves_fewest_bytes():
    from constella.llm.reshard import min_cost_flow

    flow = min_cost_flow([10, 50, 0], [20, 20, 20], lambda i, j: 0 if i == j else 1)
    assert sum(flow.values()) == 60 and flow[0, 0] == 10 and flow[1, 1] == 20
    assert sum(v for (i, j), v in flow.items() if i != j) == 30
    assert min_cost_flow([5, 5], [5, 5], lambda i, j: [[4, 1], [1, 9]][i][j]) == {(0, 1): 5, (1, 0): 5}


def test_shards(docs, spark, tmp_path):
    from constella.llm.reshard import plan, rewrite

    sized = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
                        (F.coalesce(F.col("doc_id"), F.lit(0)) % 2).cast("int").alias("old_shard"))
    got = plan(sized, 4).collect()
    assert len(got) == docs.count()
    for s in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    size = [sum(r["size"] for r in got if r["shard"] == s) for s in range(4)]
    assert max(size) - min(size) <= max(r["size"] for r in got)
    assert plan(empty(sized), 4).count() == 0
    d = docs.where("doc_id is not null").withColumn("shard", (F.col("doc_id") % 3).cast("int"))
    d.write.partitionBy("shard").parquet(str(tmp_path / "old"))
    p = {r["doc_id"]: r["shard"] for r in rewrite(spark, str(tmp_path / "old"), str(tmp_path / "new"), 4).collect()}
    out = spark.read.parquet(str(tmp_path / "new"))
    assert {r["doc_id"]: r["shard"] for r in out.collect()}.items() <= p.items()


def test_rewrite_keeps_every_row(spark, tmp_path):
    """Null ids, ids with several texts and equal rows."""
    from constella.llm.reshard import rewrite

    rows = [(i, f"text {i} " * (1 + i % 7), 0) for i in range(60)] + [(None, f"none {i}", i % 2) for i in range(9)]
    rows += [(5, "another text", 1), (5, "a third", 0), (None, None, 0)] + [(7, "equal", 0)] * 3
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    d = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    d.repartition(3).write.partitionBy("shard").parquet(old)
    p = rewrite(spark, old, new, 4).collect()
    assert len(p) == len(rows)
    touched = {s for r in p if r["shard"] != r["old_shard"] for s in (r["shard"], r["old_shard"])}
    out = spark.read.parquet(new).collect()
    left = [r for r in rows if r[2] not in touched]
    assert Counter((r["doc_id"], r["text"]) for r in out) + Counter(r[:2] for r in left) == Counter(r[:2] for r in rows)
    assert Counter((r["doc_id"], r["shard"], r["slot"]) for r in out) == Counter(
        (r["doc_id"], r["shard"], r["slot"]) for r in p if r["shard"] in touched)
    for s in touched:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in p)))


def written(spark, name, run):
    """What ``run`` gives, and the table it wrote to the shared folder."""
    import glob

    from constella.session import checkpoint_dir

    kind = f"{checkpoint_dir(spark)}/constella/{name}-*"
    before = set(glob.glob(kind))
    got = run().collect()
    new = set(glob.glob(kind)) - before
    assert len(new) == 1
    return got, spark.read.parquet(new.pop())


def test_op5_writes_the_shards(spark):
    from constella.llm.queries import op5_sharding

    sf = "/root/testdata/sf0.001"
    got, files = written(spark, "shards", lambda: op5_sharding(spark, sf))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("c")
    assert Counter((r["doc_id"], r["text_crc32"]) for r in got) == Counter(map(tuple, docs.select("doc_id", crc).collect()))
    assert set(docs.columns) <= set(files.columns)
    out = Counter(map(tuple, files.select("doc_id", crc, "shard", "slot").collect()))
    moved = [r for r in got if r["shard"] != r["old_shard"]]
    assert moved and all(out[r["doc_id"], r["text_crc32"], r["shard"], r["slot"]] == 1 for r in moved)
    assert out <= Counter((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in got)


# ------------------------------------------------------------- 6 top-k search
def test_top_k_brute_force(spark):
    from constella.llm.topk_blocks import top_k

    g = np.random.default_rng(2)
    v = np.round(g.normal(size=(300, 8)), 1).astype(np.float32)  # ties
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)]
    bad = [(1000, None), (1001, [float("nan")] * 8), (1002, [None] + [1.0] * 7), (1003, [float("inf")] * 8)]
    d = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, top_k(d, lambda c: c % 50 == 0, block=16, doc_group=64, query_group=4).collect()))
    x = np.floor(256 * v.astype(float)).astype(int)
    want = []
    for q in range(0, 300, 50):
        best = sorted((-int(x[q] @ x[i]), i) for i in range(300) if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert got == want
    assert top_k(empty(d), lambda c: c % 50 == 0).count() == 0
    assert top_k(d.where("vec_id in (0, 7)"), lambda c: c % 50 == 0).count() == 1


# --------------------------------------------------------------- 7 poisson mix
def test_mix_rates_and_repeatability(spark, docs):
    from constella.llm.poisson_mix import mix

    d = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("0123456789").alias("text"),
                                  F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    out = mix(d)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["a"] - 10000) < 500 and abs(n["b"] - 10000) < 500
    assert out.exceptAll(mix(d.repartition(7))).count() == 0
    keys = [r["order_key"] for r in out.collect()]
    assert keys == sorted(keys)
    big = mix(d.where("doc_id < 3"), budget=3 * 10 * 1500.0).count()
    assert abs(big - 4500) < 600
    assert set(mix(docs).columns) >= set(docs.columns) and mix(empty(docs)).count() == 0


def test_op7_writes_whole_documents(spark):
    from constella.llm.queries import op7_poisson_mix

    sf = "/root/testdata/sf0.001"
    got, table = written(spark, "mix", lambda: op7_poisson_mix(spark, sf))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    body = {r["doc_id"]: tuple(r) for r in docs.collect()}
    out = table.collect()
    assert all(tuple(r[c] for c in docs.columns) == body[r["doc_id"]] for r in out)
    assert Counter((r["doc_id"], r["copy"], r["order_key"]) for r in out) == Counter(
        (r["doc_id"], r["copy"], r["order_key"]) for r in got)
    keys = [r["order_key"] for r in got]
    assert keys == sorted(keys)


# ------------------------------------------------------------------ 8 byte BPE
def test_bpe_equals_tiktoken(docs, rows):
    import public_tokenizers as P
    import tiktoken

    from constella.llm.byte_bpe import Vocabulary, encode

    v = Vocabulary(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    got = {r["doc_id"]: r for r in encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    for i, text, *_ in rows:
        ids = enc.encode_ordinary(text or "")
        raw = np.array(ids, "<u4").tobytes()
        assert got[i]["ids"] == ids and got[i]["ids_sha256"] == hashlib.sha256(raw).hexdigest()
        assert bytes(got[i]["decoded"]) == (text or "").encode()
    assert encode(empty(docs), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


# -------------------------------------------------------------- 9 suffix dedup
def cut(rows):
    seen, out = {}, {}
    for i, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if seen.setdefault(b[s:s + 100], (i, s)) != (i, s):
                gone[s:s + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [500_000, 3])
def test_suffix_dedup_brute_force(docs, rows, hot):
    from constella.llm.suffix_dedup import cut_repeats, dedup

    want = cut([r[:2] for r in rows if r[0] is not None])
    got = {r["doc_id"]: tuple(r)[:5] for r in dedup(docs, hot=hot).collect()}
    assert got.pop(None)[2] == 0
    assert got == want and sum(w[2] for w in want.values()) > 0
    if hot > 3:
        kept = cut_repeats(docs)
        assert kept.columns == docs.columns and kept.count() == docs.count()
        assert dedup(empty(docs)).count() == 0


def test_blind_trie_sorts():
    from constella.llm.suffix_dedup import blind_trie, deep_shallow

    g = np.random.default_rng(1)
    x = np.concatenate([np.full((400, 60), 97), g.integers(97, 99, (400, 40))], axis=1).astype(np.uint8)
    s = [r.tobytes() for r in x]
    assert [s[i] for i in blind_trie(s)] == sorted(s)
    order, same = deep_shallow(x)
    assert [s[i] for i in order] == sorted(s)
    t = sorted(s)
    assert same.tolist() == [next((k for k in range(100) if a[k] != b[k]), 100) for a, b in zip(t, t[1:])]


# ------------------------------------------------------------- 10 n-gram join
@pytest.mark.parametrize("split_at", [1_000_000, 4])
def test_ngram_join_brute_force(docs, rows, split_at):
    from constella.llm.ngram_join import near_duplicates

    sets = {}
    for i, text, *_ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets if i is not None}
    changed = True
    while changed:
        changed = False
        for a in comp:
            for b in comp:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and comp[b] < comp[a]:
                    comp[a], changed = comp[b], True
    got = {r["doc_id"]: tuple(r)[1:] for r in near_duplicates(docs, split_at=split_at).collect()}
    assert got.pop(None)[1] is None
    assert got == {i: (len(sets[i]), comp[i]) for i in comp}
    assert near_duplicates(empty(docs)).count() == 0


def test_ngram_join_repeated_ids(spark):
    """Rows that repeat an id, with equal and with other texts, by brute force."""
    from constella.llm.ngram_join import near_duplicates

    w = lambda p, n: [f"{p}{k}" for k in range(n)]
    rare, left, right, far = w("s", 30), w("p", 30), w("q", 30), w("c", 60)
    texts = [(1, rare + left), (1, rare + left), (2, rare + right), (2, rare + right),  # Jaccard 0.3
             (3, w("d", 50)), (3, far), (4, far + ["z"]), (5, w("e", 40)), (5, w("e", 40)), (6, w("e", 41))]
    texts += [(10 + k, left + w(f"l{k}x", 100)) for k in range(6)] + [(30 + k, right + w(f"r{k}x", 100)) for k in range(6)]
    sets = [(i, {tuple(t[k:k + 5]) for k in range(len(t) - 4)}) for i, t in texts]
    comp = {i: i for i, _ in sets}
    for _ in comp:
        for i, a in sets:
            for j, b in sets:
                if 100 * len(a & b) >= 80 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert comp[2] == 2 and comp[4] == 3 and comp[6] == 5
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string")
    for d in (docs.coalesce(1), docs.repartition(4)):
        got = near_duplicates(d).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == comp and len(got) == len(texts)


def test_ngram_join_keeps_partners_within_reach():
    """Every pair that the threshold allows at its first common shingle stays
    within reach of each other; all others of a shingle may leave."""
    from constella.llm.ngram_join import POSTING, _reach, _with_partners

    g = np.random.default_rng(5)
    post = np.zeros(600, POSTING)
    post["t"], post["d"], post["n"] = g.integers(0, 60, 600), np.arange(600), g.integers(1, 60, 600)
    post["r"] = post["n"] - (post["n"] * g.uniform(0, 0.2, 600)).astype(int)
    kept = set(_with_partners(post, 80)["d"].tolist())
    reach = _reach(post["n"], post["r"], 80)
    for a in post:
        for b in post[(post["t"] == a["t"]) & (post["d"] != a["d"])]:
            most = min(int(a["r"]), int(b["r"]))
            links = 100 * most >= 80 * (int(a["n"]) + int(b["n"]) - most)
            assert links == (b["n"] <= reach[a["d"]] and a["n"] <= reach[b["d"]])
            assert not links or {int(a["d"]), int(b["d"])} <= kept
    assert len(kept) < 600 and len(_with_partners(post[:0], 80)) == 0


def test_ngram_join_shared_passage(spark):
    """Texts around one shared passage: some link, most only share it."""
    from constella.llm.ngram_join import near_duplicates

    g = np.random.default_rng(11)
    passage = [f"p{k}" for k in range(60)]
    texts = []
    for k in range(120):
        own = [f"w{k}x{j}" for j in range(int(g.integers(0, 16)))]
        texts.append(" ".join(own + passage) if k % 2 else " ".join(passage + own))
    near = texts[7].split() + ["z"]
    texts += [" ".join(near), " ".join(near[:-3]), texts[9]]
    sets = [{tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    comp = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(texts)):
            for b in range(len(texts)):
                if comp[b] < comp[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a], changed = comp[b], True
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs).collect()}
    assert got == dict(enumerate(comp)) and 1 < len(set(comp)) < len(texts)


# -------------------------------------------------------------------- pipeline
def test_pipeline_runs_all_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][1] == "n-gram Jaccard join"
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d.limit(0), sf).columns == d.columns
