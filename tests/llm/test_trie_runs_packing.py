"""Operators 11 to 13 against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from constella.llm.queries import BYTE_BPE_JSON, planted_order

CONV = "conv_id long, turn long, role string, text string, base int, path int, words int, n int, depth int"


def conversations(spark):
    r = random.Random(4)
    rows = []
    for c in range(1, 90):
        n = r.choice([1, 2, 3, 5, 9]) if c != 50 else 60
        for t in range(n):
            # few different texts: many shared prefixes, one of them hot
            text = "same start here" if t == 0 and c % 3 else f"w{r.randrange(2)} \t x" * r.randrange(3)
            rows.append((c, t, r.choice(["user", None]) if t > 3 else "user", text or None))
    rows += [(c, t, "user", f"copy {t}") for c in range(2000, 3200) for t in range(2)]  # over CHUNK equal ones
    rows += [(4000, None, "user", "null turn"), (4000, 1, "user", "b"), (4000, 1, "user", "a"), (4000, 1, "user", "a"),
             (None, 1, "user", "no conversation"), (-5, 0, "user", "same start here"), (4001, 0, None, None),
             (4002, 0, "user", "long " * 50_000)]
    return spark.createDataFrame([(*x, 1, 2, 3, 4, 5) for x in rows], CONV).repartition(5), rows


def plain_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, key, role, text))
    convs = {c: [x[3:] for x in sorted(t)] for c, t in convs.items()}
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out, leaves, saved = {}, dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    kids = dict.fromkeys(nodes, 0)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, members in nodes.items():
        mine = (len(members) - 1) * len(p[-1][1].encode().split()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += mine
            leaves[p[:d]] += kids[p] == 0
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(p))
        out[p] = (min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], leaves[p], saved[p],
                  hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_trie_equals_plain_version(spark, ranges):
    from constella.llm.prefix_trie import paths, trie, turn_lists

    table, rows = conversations(spark)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:  # a node's members lie in one or in many ranges
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = [tuple(x) for x in trie(paths(turn_lists(table))).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(got, key=str) == plain_trie(rows)


def test_trie_of_turnless_and_empty_tables(spark):
    from constella.llm.prefix_trie import EMPTY, paths, trie, turn_lists

    table, _ = conversations(spark)
    assert trie(paths(turn_lists(table.limit(0)))).count() == 0
    alone = spark.createDataFrame([(7, bytearray(b""), bytearray(b"")), (3, bytearray(b""), bytearray(b""))],
                                  "conv_id long, path binary, words binary")
    assert [tuple(x) for x in trie(alone).collect()] == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,7").hexdigest())]
    assert EMPTY == hashlib.sha256(b"").hexdigest()


def plain_runs(w, least, times):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, times * q):
                s = w[i:i + n]
                if not any(s[p:] == s[:-p] for p in range(1, q)):
                    out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


@pytest.mark.parametrize("least, times", [(24, 3), (4, 2), (1, 3)])
def test_runs_equal_plain_version(least, times):
    from constella.llm.periodic_runs import runs_of

    r = random.Random(least)
    for _ in range(25):
        texts = []
        for _ in range(r.randrange(1, 7)):
            n, kinds = r.choice([0, 1, 5, 40, 300]), r.choice([1, 2, 3, 60])
            w = [1 + r.randrange(kinds) for _ in range(n)]
            if n and r.random() < 0.7:
                a = r.randrange(n)
                p = 1 + r.randrange(max(1, (n - a) // 2))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        assert runs_of([np.array(w, np.int64) for w in texts], least, times) == [plain_runs(w, least, times) for w in texts]


def test_run_over_a_long_text():
    from constella.llm.periodic_runs import runs_of

    w = np.concatenate([np.arange(1, 1001), np.tile(np.arange(2000, 2700), 60), [1]])
    assert runs_of([w, w[:900]], 24, 3) == [[(1000, 42000, 700)], []]


def test_cover_meets_every_pair():
    from constella.llm.periodic_runs import COVER, SAMPLED

    assert {(a - b) % COVER for a in SAMPLED for b in SAMPLED} == set(range(COVER))


def run_row(doc_id, text, order=planted_order):
    w = (text or "").encode().split()
    places = order(doc_id, len(w)) if w else None
    if places is not None:
        w = [w[i] for i in places]
    runs = plain_runs(w, 24, 3)
    best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(w), len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_periodic_runs_of_documents(spark, docs, rows):
    from constella.llm.periodic_runs import find_runs

    clash = docs.selectExpr("*", "1 AS n_words", "2 AS start", "3 AS runs", "4 AS period")
    got = [tuple(x) for x in find_runs(clash.union(clash.limit(3)), full=False, order=planted_order).collect()]
    want = [run_row(x[0], x[1]) for x in rows]
    assert set(got) == set(want) and len(got) == len(want) + 3
    full = find_runs(docs.where("doc_id = 60")).first()
    assert (full.n_words, [tuple(x) for x in full.runs], full.collapsed) == (4000, [(0, 4000, 1)], "word")
    assert find_runs(docs.limit(0)).count() == 0


def test_packing_round_trip(spark, docs, rows, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from constella.llm.binary_packing import pack, read_packed

    tokenizer = Tokenizer.from_file(public_tokenizers.path(BYTE_BPE_JSON))
    tokenizer.encode_special_tokens = True
    odd = [(900, "<|endoftext|> it's  two   spaces\n\n \t tab nbsp 日本 x"), (901, "a" * 5000), (902, " "), (900, "same id")]
    more = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], docs.schema)
    table = docs.union(more).selectExpr("*", "1 AS length", "2 AS ids", "3 AS spread", "4 AS sequence_id")
    for name, vocabulary in (("all", table), ("none", table.limit(0))):
        pack(vocabulary, str(tmp_path / name), public_tokenizers.path(BYTE_BPE_JSON), public_tokenizers.PATTERN, longest=64)
    assert read_packed(spark, str(tmp_path / "none")).count() == 0
    got = read_packed(spark, str(tmp_path / "all")).collect()
    want = []
    for doc_id, text in [x[:2] for x in rows] + odd:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        while at < len(ids):
            n = min(64, 1 << ((len(ids) - at).bit_length() - 1))
            want.append((doc_id, at, n, zlib.crc32(np.array(ids[at:at + n], "<u4").tobytes()), len(ids)))
            at += n
    assert sorted(((x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens) for x in got), key=str) == sorted(want, key=str)
    for x in got:
        assert zlib.crc32(np.frombuffer(x.ids, "<u2").astype("<u4").tobytes()) == x.ids_crc32
    assert len({x.sequence_id for x in got}) == len(got) and {x.offset for x in got} == {0}


def test_cuts_are_binary():
    from constella.llm.binary_packing import cuts

    assert cuts(1, 2048) == [(0, 1)]
    assert cuts(2 * 2048 + 13, 2048) == [(0, 2048), (2048, 2048), (4096, 8), (4104, 4), (4108, 1)]
    assert cuts(3, 1) == [(0, 1), (1, 1), (2, 1)]


def test_cut_repeats_keeps_texts_of_one_id_apart(spark):
    from constella.llm.suffix_dedup import cut_repeats

    passage = "".join(random.Random(1).choices("abcdefghij", k=150))
    rows = [(1, "a" * 10, 0), (1, "b" * 10, 1), (2, passage + " first", 2), (3, passage + " then", 3), (4, None, 4), (None, "x", 5)]
    got = {r["__n"]: r["text"] for r in cut_repeats(spark.createDataFrame(rows, "doc_id long, text string, __n long")).collect()}
    assert got == {0: "a" * 10, 1: "b" * 10, 2: passage + " first", 3: "then", 4: None, 5: "x"}


def test_classifier_takes_one_row_an_id(spark, monkeypatch):
    """An id with thousands of rows brings one of them to the fit."""
    from constella.llm import ordinal_quality as Q

    docs = spark.createDataFrame([(1, f"text number {i}") for i in range(3000)] + [(i, f"word{i} more") for i in range(2, 60)] + [(70, None)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in [*range(1, 60), 70]], "doc_id long, quality long, toxic long")
    seen = []
    fit = Q.fit
    monkeypatch.setattr(Q, "fit", lambda rows, *rest: seen.append(len(rows)) or fit(rows, *rest))
    Q.train(docs, labels, per_grade=10)
    assert seen == [20]
