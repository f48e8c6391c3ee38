import random

import pytest

from shelfmark.llm import packing as P


def test_every_text_once_within_capacity_and_conflicts(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randint(1, 300))), f"s{i % 3 if i % 2 else 0}") for i in range(300)]
    docs += [(1000 + i, "the same text", None) for i in range(7)] + [(2000, "long " * 3000, "s1"), (2001, None, "s1"), (2002, "", "s1"), (0, docs[0][1], docs[0][2]), (None, "x", "s")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("tokens", P.F.lit(1)).withColumn("cluster", P.F.lit(1))
    c = spark.createDataFrame([("a", 256), ("b", 1000), ("b", 1000), (None, 5), ("zero", 0)], "container_class string, capacity_tokens int")
    counts = P.token_counts(d)
    tokens = {r.doc_id: r.tokens for r in counts.collect()}
    assert set(tokens) == {x for x, t, _ in docs if t and x is not None}
    text = {x: t for x, t, _ in docs}
    packed = P.pack(counts, c).collect()
    for name, cap in (("a", 256), ("b", 1000)):
        own = [r for r in packed if r.container_class == name]
        total, boxes = {}, {}
        for r in own:
            total[r.doc_id] = total.get(r.doc_id, 0) + r.tokens
            boxes.setdefault(r.container_id, []).append(r)
        assert total == tokens and all(sum(x.tokens for x in b) <= cap for b in boxes.values())
        assert all((len([r for r in own if r.doc_id == x]) > 1) == (n > cap) for x, n in tokens.items())
        for b in boxes.values():
            texts = [text[r.doc_id] for r in b]
            assert len(texts) == len(set(texts))
        assert sum(tokens.values()) / (cap * len(boxes)) > 0.8
    assert P.pack(P.token_counts(d.limit(0)), c).count() == 0 and P.pack(counts, c.limit(0)).count() == 0
    assert {r.container_class for r in P.fill_report(P.pack(counts, c), c).collect()} == {"a", "b"}


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_takes_the_tightest_compatible(seed):
    rng = random.Random(seed)
    items = sorted(((rng.randint(1, 100), rng.randint(0, 2), rng.choice([-1, -1, 0, 1])) for _ in range(80)), reverse=True)
    quota, copies = [1, 2, 50], {0: 1, 1: 2}
    got = P.best_fit(items, 100, quota, {1: 2})
    boxes = []  # brute force: left, sources, clusters
    for (n, s, c), place in zip(items, got, strict=True):
        fits = [(b[0], i) for i, b in enumerate(boxes) if b[0] >= n and b[1].count(s) < quota[s] and (c < 0 or b[2].count(c) < copies[c])]
        want = min(fits)[1] if fits else len(boxes)
        if want == len(boxes):
            boxes.append([100, [], []])
        assert place == want
        boxes[want][0] -= n
        boxes[want][1].append(s)
        boxes[want][2].append(c) if c >= 0 else None


def test_counts_are_those_of_the_tokenizer(spark):
    import tiktoken

    e = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=P.read_ranks(P.TOKENIZER), special_tokens={})
    texts = ["Hello world", "第一頁 <|endoftext|>", " \n\t x", "é🙂"]
    d = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id int, text string, source string")
    assert {r.doc_id: r.tokens for r in P.token_counts(d).collect()} == {i: len(e.encode_ordinary(t)) for i, t in enumerate(texts)}
    assert all(e.decode(e.encode_ordinary(t)) == t for t in texts)


def test_copies_of_a_third_of_all_rows_leave_little_space():
    rows = [(i, "s", 1 if i % 3 == 0 else i + 10, 40 + i % 17) for i in range(3000)]
    packed = P.pack_shard(rows, 512, {"s": 1000})
    assert len({p[0] for p in packed}) == 3000
    used = len({p[3] for p in packed})
    assert sum(r[3] for r in rows) / (used * 512) > 0.95
