import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from strainweave.llm import chunking, grouping, leakage, mixing, tokens, topn

EDGES = "source string, target string, snp_distance int, lo string, n long"


def groups(rows, high=20):
    clean = lambda x: (x or "").strip(" \t") or None
    up = {x: x for r in rows for x in (clean(r[0]), clean(r[1])) if x}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for s, t, d in rows:
        s, t = clean(s), clean(t)
        if s and t and d is not None and 0 <= d <= high:
            a, b = sorted((top(s), top(t)))
            up[b] = a
    return {x: top(x) for x in up}


def group(spark, rows, heavy_rows):
    df = spark.createDataFrame([(*r, "lo", 1) for r in rows], EDGES)
    got = grouping.group_ids(df, heavy_rows=heavy_rows).collect()
    assert len(got) == len({r.isolate_id for r in got})
    return {r.isolate_id: r.group_id for r in got}


@pytest.mark.parametrize("heavy_rows", [2, 10**9])
def test_groups_as_union_find(spark, heavy_rows):
    rng = random.Random(2)
    name = lambda i: rng.choice(["", " ", "\t"]) + f"n{i:03d}" + rng.choice(["", " "])
    rows = [(name(rng.randrange(90)), name(rng.randrange(90)), rng.choice([0, 20, 21, -1, None, 5])) for _ in range(90)]
    rows += [("hub", name(i), 3) for i in range(0, 40)] + [(f"c{i:02d}", f"c{(i * 7 + 3) % 31:02d}", 1) for i in range(31)]
    rows += [("A", "A", 1), ("a", "A", 30), (None, "x", 1), ("y", " ", 1), (None, None, 1), ("hub", name(3), 3)]
    assert group(spark, rows, heavy_rows) == groups(rows)


def test_long_path_and_empty(spark):
    ids = [f"p{i:02d}" for i in range(40)]
    random.Random(1).shuffle(ids)
    rows = [(a, b, 1) for a, b in zip(ids, ids[1:])]
    assert group(spark, rows, 10**9) == groups(rows)
    assert group(spark, [], 10) == {}
    assert group(spark, [("a", None, None)], 10) == {"a": "a"}


@pytest.mark.parametrize("heavy_rows", [3, 10**9])
@pytest.mark.parametrize("shares", [(0.02, 0.1, 0.35), (0.5,), (0.9, 0.1)])
def test_top_items_as_sorted(spark, heavy_rows, shares):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4, -1, None]), rng.choice(["", " ", "x", "b ", "c", "d", "e", "f", "É", "g", "h", None]), rng.choice([0.0, -0.0, 0.1, 0.1, 0.5, 1.0, float("nan"), None, -2.0, float("inf")]), "s", 1) for _ in range(300)]
    df = spark.createDataFrame(rows, "grp int, item string, score double, s string, rank_no int")
    best = {}
    for g, i, s, *_ in rows:
        i = (i or "").strip()
        if g is not None and i and s is not None and not math.isnan(s):
            best[g, i] = max(best.get((g, i), -math.inf), s)
    want = []
    for g in {g for g, _ in best}:
        ranked = sorted(((-s, i.encode()) for (h, i), s in best.items() if h == g))[:3]
        want += [(g, k, i.decode(), -s + 0.0) for k, (s, i) in enumerate(ranked, 1)]
    got = topn.top_items(df, "grp", "item", "score", 3, shares, heavy_rows).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert topn.top_items(df.limit(0), "grp", "item", "score", 3).count() == 0


REMOVED = dict.fromkeys([0x200B, 0x200C, 0x200D, 0xFEFF, 0xAD])


def plain_words(t):
    return [w.lower() for w in re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", t or "").translate(REMOVED))]


def test_leaks_as_all_runs(spark):
    rng = random.Random(6)
    vocabulary = ["alpha", "Beta", "ﬁne", "café", "x1", "ÄB", "日本", "don't", "a_b", "ＷＩＤＥ", "½"]
    sentence = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", " ", " - "]) for _ in range(n))
    items = [(k, sentence(rng.choice([1, 4, 11, 12, 13, 40, 80]))) for k in range(12)] + [(50, ""), (51, None), (52, "..."), (None, "alpha Beta x1")]
    docs = []
    for k in range(60):
        t = sentence(rng.randrange(30))
        _, item = items[rng.randrange(12)]
        w = item.split(" ")
        a = rng.randrange(len(w))
        docs.append((k, t + " ".join(w[a : a + rng.randrange(1, 30)]).upper().replace("E", "é" if k % 5 == 0 else "E­") + " " + t))
    docs += [(100, None), (101, ""), (102, "!!!"), (2**60 + 1, items[5][1]), (2**60 + 1, items[5][1]), (None, items[5][1]), (103, "word " * 50_000 + items[7][1])]
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, eval_id int")
    e = spark.createDataFrame([(a, b, "d") for a, b in items], "eval_id long, text string, doc_id string")
    want = set()
    for k, t in docs:
        w = plain_words(t)
        for i, item in items:
            v = plain_words(item)
            n = min(12, len(v))
            if i is not None and n and {tuple(v[x : x + n]) for x in range(len(v) - n + 1)} & {tuple(w[x : x + n]) for x in range(len(w) - n + 1)}:
                want.add((k, i))
    for block in (leakage.BLOCK_CHARS, 200):
        got = leakage.find_leaks(d, e, block_chars=block).collect()
        assert {(r.doc_id, r.eval_id) for r in got} == want
    texts, by = dict(docs), dict(items)
    for r in got:
        passage = plain_words(texts[r.doc_id][r.start_at : r.end_at])
        v = plain_words(by[r.eval_id])
        assert r.passage == texts[r.doc_id][r.start_at : r.end_at] and len(passage) == r.n_words and any(v[x : x + r.n_words] == passage for x in range(len(v)))
    assert leakage.find_leaks(d, e.limit(0)).count() == 0 and leakage.find_leaks(d.limit(0), e).count() == 0


def test_offsets_lead_back():
    for text in ("plain", "éa­b", "ﬁx Ⅳ ½ 日本", "한 x", "a﻿​b"):
        n, o = leakage.normal_text(text), leakage.origin_offsets(text)
        assert len(o) == len(n) + 1 and o == sorted(o) and o[-1] == len(text)


def test_mixture(spark):
    rng = random.Random(8)
    docs = [(i, rng.choice(["big", " BIG", "Big\t"]) if i < 900 else "small" if i < 960 else rng.choice(["tiny", "other", None]), " ".join(["word"] * rng.randrange(0, 60)) or None, i) for i in range(1000)]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string, copy_no int")
    t = spark.createDataFrame([("big", 0.5, 1), ("Small ", 0.1, 4), ("tiny", 0.3, 2), ("absent", 0.1, 9)], "source string, target_share double, max_repeats int")
    s = {r.source: r for r in mixing.shares(d, t).collect()}
    for name in ("big", "small"):
        assert abs(s[name].actual_tokens - s[name].target_tokens) <= 120
    assert s["tiny"].actual_tokens == 2 * s["tiny"].source_tokens and s["absent"].actual_tokens == 0
    assert abs(sum(r.actual_share for r in s.values()) - 1) < 1e-9
    m = mixing.mixture(d, t).collect()
    used = {}
    for r in m:
        used[r.doc_id] = used.get(r.doc_id, 0) + 1
    clean = {i: (x or "").strip().lower() for i, x, *_ in docs}
    assert max(k for i, k in used.items() if clean[i] == "big") == 1 and max(k for i, k in used.items() if clean[i] == "small") <= 4
    assert {clean[i] for i in used} == {"big", "small", "tiny"}
    assert [r.position_key for r in m] == sorted(r.position_key for r in m)
    assert sorted(tuple(r) for r in mixing.mixture(d.repartition(5), t).collect()) == sorted(tuple(r) for r in m)
    assert mixing.mixture(d.limit(0), t).count() == 0 and mixing.shares(d.limit(0), t).count() == 4


def test_poisson_inverse(spark):
    steps = mixing.poisson_steps(1.3, 6)
    k = spark.range(20_000).select(mixing.copies(mixing.uniform(F.col("id"), 3), F.array(*[F.lit(x) for x in steps])).alias("k")).groupBy("k").count().collect()
    p = {r.k: r["count"] / 20_000 for r in k}
    assert all(abs(p[i] - math.exp(-1.3) * 1.3**i / math.factorial(i)) < 0.02 for i in range(4))


def test_pieces(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12)))
    prose = lambda n, ends: "".join(word() + rng.choice(ends) for _ in range(n))
    texts = [None, "", "short", prose(900, [" ", " ", " ", ". ", "\n", "\n\n", ' ("x") ']), prose(2000, [" "]), "a" * 9000, "日本語の文です。" * 700, "🎉" * 1500, " " * 5000, "\n" * 4000, "x\r\n\r\n" * 1500, "<|endoftext|>" * 300, prose(600, ["! "]), prose(60_000, [" ", ". "])]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id int, text string, piece_no int, ends string")
    encoding = tokens.load(tokens.vocabulary())[0]
    for limit, overlap in ((512, 64), (100, 10), (64, 0)):
        by = {}
        for r in chunking.split_texts(d, limit, overlap).collect():
            by.setdefault(r.doc_id, []).append(r)
        assert set(by) == {i for i, t in enumerate(texts) if t and len(encoding.encode_ordinary(t)) > limit}
        for i, rows in by.items():
            rows.sort(key=lambda r: r.piece_no)
            t = texts[i]
            assert [r.piece_no for r in rows] == list(range(1, len(rows) + 1)) and rows[0].start_at == 0 and rows[-1].end_at == len(t)
            for a, b in zip(rows, rows[1:]):
                assert overlap <= a.token_to - b.token_from <= overlap + 3 and a.start_at <= b.start_at <= a.end_at < b.end_at
                if i in (3, 4, 12, 13):
                    assert t[a.end_at - 1].isspace() != t[a.end_at].isspace() or t[a.end_at - 1] in '\n").'
            for r in rows:
                assert r.piece == t[r.start_at : r.end_at] and r.n_tokens <= limit and len(encoding.encode_ordinary(r.piece)) <= limit
    assert chunking.split_texts(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chunking.piece_pattern(64, 62)


def plain_boundary(text, at):
    if at >= len(text):
        return "P"
    before, after = text[at - 1], text[at]
    if before == "\n" and not after.isspace():
        head = text[: at - 1]
        while head and head[-1].isspace() and head[-1] != "\n":
            head = head[:-1]
        return "P" if head.endswith("\n") else "S"
    head = text[:at].rstrip("\"')]}”’»」")
    stop = head[-1:]
    if stop and (after.isspace() and stop in ".!?…" or stop in "。！？" and after not in "\"')]}”’»」"):
        return "S"
    return "W" if after.isspace() != before.isspace() else "c"


def test_boundaries_by_strength():
    at = lambda text, k: chunking.boundaries(text)[k - 1].decode()
    for text, k, want in (("a\n\nb", 3, "P"), ("a.\nb", 3, "S"), ("a. b", 2, "S"), ('a." b', 3, "S"), ("a b", 1, "W"), ("ab", 1, "c"), ("です。次", 3, "S"), ("ab", 2, "P"), ("3.5", 2, "c")):
        assert at(text, k) == want == plain_boundary(text, k), text
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("a。.!)\"' \n\t\r\u3000é🎉」") for _ in range(rng.randrange(1, 40)))
        assert [b.decode() for b in chunking.boundaries(text)] == [plain_boundary(text, k) for k in range(1, len(text) + 1)], text
    assert len(chunking.boundaries("")) == 0


def test_rates_beyond_what_exp_holds():
    steps = mixing.poisson_steps(760.0, 1000)
    assert abs(steps[759] - 0.5) < 0.05 and steps[600] < 1e-6 and steps[-1] > 1 - 1e-9 and steps == sorted(steps)
    assert mixing.poisson_steps(0.0, 3) == [1.0] * 3


def test_too_many_items_are_refused(spark):
    one = spark.createDataFrame([(1, "some words here")], "eval_id long, text string")
    with pytest.raises(ValueError, match="cannot be broadcast"):
        leakage.find_leaks(one.withColumnRenamed("eval_id", "doc_id"), one, max_chars=5)
    assert leakage._blocks([(1, "aaa"), (2, "bb"), (3, "cccccc"), (4, "d")], 5) == [[(1, "aaa"), (2, "bb")], [(3, "cccccc")], [(4, "d")]]
