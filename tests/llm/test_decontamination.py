import random
import time

from priorframe.llm import decontamination as D

DOCS = "doc_id long, text string, item_id string"


def test_reordered_passages_are_tiled():
    item = list(range(1, 41))
    text = [99] * 5 + item[20:] + [0] * 3 + item[:20] + [98]
    assert sorted(D.tile(item, text)) == [(20, 0, 28), (20, 20, 5)]


def test_tiles_do_not_overlap_and_longest_go_first():
    rng = random.Random(1)
    for _ in range(200):
        item = [rng.randint(1, 3) for _ in range(rng.randint(1, 40))]
        text = [rng.randint(0, 3) for _ in range(rng.randint(0, 60))]
        tiles = D.tile(item, text)
        for part in (1, 2):
            used = [p for t in tiles for p in range(t[part], t[part] + t[0])]
            assert len(used) == len(set(used))
        assert all(item[i : i + n] == text[j : j + n] and n >= 5 for n, i, j in tiles)
        free_i, free_j = set(range(len(item))), set(range(len(text)))
        for n, i, j in tiles:
            free_i -= set(range(i, i + n))
            free_j -= set(range(j, j + n))
        for i in range(len(item) - 4):  # nothing of the seed length is left to mark
            for j in range(len(text) - 4):
                if free_i >= set(range(i, i + 5)) and free_j >= set(range(j, j + 5)):
                    assert item[i : i + 5] != text[j : j + 5]
        longest = max((n for i in range(len(item)) for j in range(len(text)) for n in [run(item, text, i, j)]), default=0)
        assert max((t[0] for t in tiles), default=0) == (longest if longest >= 5 else 0)


def run(item, text, i, j):
    n = 0
    while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n]:
        n += 1
    return n


def tables(spark):
    words = [f"t{i}" for i in range(30)]
    item, half = " ".join(words), " ".join(words[:15])
    docs = [
        (1, f"before {item.upper()}, after", "x"), (2, f"{' '.join(words[15:])} and {half}", "x"), (3, half, "x"), (4, None, "x"), (5, "", None),
        (6, " ".join(reversed(words)), "x"), (None, item, "x"), (1, f"before {item.upper()}, after", "x"),
    ]
    bench = [(10, item), (11, "too short now"), (12, None), (13, "none of this is in any of the documents at all"), (10, item)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, "item_id long, text string")


def test_both_joins_give_the_same_leaks(spark):
    docs, bench = tables(spark)
    near = sorted((r.doc_id or 0, r.item_id, r.coverage, r.n_tiles) for r in D.leaks(docs, bench).collect())
    assert near == [(0, 10, 1.0, 1), (1, 10, 1.0, 1), (1, 10, 1.0, 1), (2, 10, 1.0, 2)]
    far = sorted((r.doc_id or 0, r.item_id, r.coverage, r.n_tiles) for r in D.leaks(docs, bench, broadcast_words=0).collect())
    assert far == near


def test_removal_keeps_clean_rows_and_columns(spark):
    docs, bench = tables(spark)
    for words in (D.BROADCAST_WORDS, 0):
        out = D.remove_leaks(docs, bench, broadcast_words=words)
        assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [3, 4, 5, 6]
    assert D.leaks(docs.limit(0), bench).count() == 0 and D.leaks(docs, bench.limit(0)).count() == 0


def test_whole_table_against_plain_search(spark, sf):
    """Whole items that stand in a document word by word are found, and nothing of low overlap is."""
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = {r.doc_id: f" {' '.join(D.words_of(r.text))} " for r in docs.collect()}
    items = {r.item_id: " ".join(D.words_of(r.text)) for r in bench.collect()}
    want = {(d, i) for d, t in texts.items() for i, x in items.items() if f" {x} " in t}
    got = {(r.doc_id, r.item_id): r.coverage for r in D.leaks(docs, bench).collect()}
    assert want <= set(got)
    for (d, i), share in got.items():
        seeds = items[i].split()
        grams = [f" {' '.join(seeds[k : k + 5])} " for k in range(len(seeds) - 4)]
        assert share >= 0.8 and sum(g in texts[d] for g in grams) >= 0.5 * len(grams)


def test_repetitive_texts_take_no_cubic_time():
    for m, n in ((100, 3000), (200, 3000), (40, 20_000)):
        began = time.perf_counter()
        assert [t[0] for t in D.tile([1] * m, [1] * n)] == [m]
        assert [t[0] for t in D.tile([1, 2] * (m // 2), [1, 2] * (n // 2))] == [m]
        assert time.perf_counter() - began < 20


def plain_coverage(item, text):
    """Greedy string tiling by its definition: mark the longest common run of free words until none of five is left."""
    free_i, free_j, total = [True] * len(item), [True] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n] and free_i[i + n] and free_j[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < 5:
            return total / len(item)
        free_i[i : i + n], free_j[j : j + n] = [False] * n, [False] * n
        total += n


def test_tiles_equal_the_definition():
    """Small alphabets and overlapping passages, where longer tiles cut shorter ones: length by length the same tiles."""
    rng = random.Random(12)
    for k in range(4000):
        if k % 2:
            size = rng.choice([2, 3, 4])
            item, text = ([rng.randint(1, size) for _ in range(rng.randint(0, 40))] for _ in range(2))
        else:
            item = list(range(1, 61))
            text = []
            for _ in range(rng.randint(1, 5)):
                a = rng.randrange(55)
                text += item[a : a + rng.randint(3, 25)]
        assert sum(t[0] for t in D.tile(item, text)) == round(plain_coverage(item, text) * len(item)) if item else D.tile(item, text) == []


def test_coverage_against_plain_tiling(spark):
    rng = random.Random(3)
    items = {k: [f"t{k}_{i}" for i in range(rng.randint(6, 24))] for k in range(6)}
    docs = {}
    for d in range(40):
        words = []
        for _ in range(rng.randint(0, 4)):
            item = items[rng.randrange(6)]
            a = rng.randrange(len(item))
            words += item[a : a + rng.randint(3, 24)] + ["gap"] * rng.randint(0, 2)
        docs[d] = words
    want = {(d, k): plain_coverage(x, t) for d, t in docs.items() for k, x in items.items()}
    table = spark.createDataFrame([(d, " ".join(t)) for d, t in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in items.items()], "item_id long, text string")
    for words in (D.BROADCAST_WORDS, 0):
        got = {(r.doc_id, r.item_id): r.coverage for r in D.leaks(table, bench, broadcast_words=words, coverage=0.3).collect()}
        assert got == {k: v for k, v in want.items() if v >= 0.3}
