import random

import numpy as np
from pyspark.sql import functions as F
from ravelin.llm import decontaminate as d


def brute(item, text):
    """Fewest edits that turn a stretch of the text into the item."""
    a, b = d.plain(item).tolist(), d.plain(text).tolist()
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def edited(r, text, n):
    c = list(text)
    for _ in range(n):
        at = r.randrange(len(c))
        k = r.random()
        if k < 0.4:
            c[at] = "#"
        elif k < 0.7:
            del c[at]
        else:
            c.insert(at, "~")
    return "".join(c)


def test_against_brute_force(prose):
    r = random.Random(8)
    items = [(i, prose(1000 + i, 14 + i)) for i in range(8)] + [(90, "short"), (91, "abcdefghij"), (92, "")]
    block = d.Block(items)
    for t in range(60):
        i, item = items[r.randrange(8)]
        text = prose(t, r.randint(0, 30)) + " " + edited(r, item, r.randint(0, 16)) + " " + prose(t + 500, r.randint(0, 30))
        got = {x: (s, e, k) for x, s, e, k in block.hits(text)}
        for j, other in items[:8] + [items[9]]:
            best, most = brute(other, text), d.edits_allowed(len(other))
            assert (j in got) == (best <= most), (j, best, most)
            if j in got:
                s, e, k = got[j]
                assert k == best and brute(other, text[s:e]) == k


def test_runs_of_a_long_text(prose, monkeypatch):
    item = prose(1, 30)
    block = d.Block([(7, item)])
    monkeypatch.setattr(d, "RUN_CHARS", 600)
    for at in range(0, 4000, 173):
        text = prose(2, 900)
        text = text[:at] + item + text[at:]
        assert block.hits(text) == [(7, at, at + len(item), 0)]


def test_case_and_blanks_do_not_matter(prose):
    item = prose(3, 25)
    assert d.Block([(1, item)]).hits("x " + item.upper().replace(" ", "\n"))[0][3] == 0


def test_align_finds_inner_gaps():
    a, b = (np.array([ord(c) for c in s]) for s in ("abcdefgh", "zzabcXdefhzz"))
    assert d.align(a, b, 2) == (2, 2, 10) and d.align(a, b, 1) is None


def test_tables(spark, prose, odd_rows, monkeypatch):
    items = [(i, prose(50 + i, 30)) for i in range(5)] + [(9, None), (10, ""), (0, prose(50, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [*odd_rows, (20, prose(9, 50) + " " + items[2][1]), (20, prose(9, 50) + " " + items[2][1]), (21, prose(10, 80)), (22, items[0][1] + " " + items[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1))
    expected = sorted([(20, 2), (20, 2), (22, 0), (22, 1)])
    assert sorted((r.doc_id, r.item_id) for r in d.contamination(docs, bench).collect()) == expected
    monkeypatch.setattr(d, "BLOCK_CHARS", 200)  # several blocks
    assert sorted((r.doc_id, r.item_id) for r in d.contamination(docs, bench).collect()) == expected
    kept = d.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert d.contamination(docs, bench.limit(0)).count() == 0 and d.clean(docs, bench.limit(0)).count() == len(rows)
    assert d.contamination(docs.limit(0), bench).count() == 0


def test_many_short_items_take_memory_by_hits(prose):
    """Twenty thousand items against a long text: only cells that are hit are held."""
    import tracemalloc

    r = random.Random(3)
    items = [(i, "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(24))) for i in range(20_000)]
    block = d.Block(items)
    text = " ".join(["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(50_000)), items[77][1], edited(r, items[78][1], 1)])
    tracemalloc.start()
    got = block.hits(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 77 in {x[0] for x in got} and brute(items[78][1], text[-40:]) <= 1
    assert (78 in {x[0] for x in got}) and peak < 20e6


def test_popular_grams_in_parts(prose, monkeypatch):
    items = [(i, "-" * 40 + prose(i, 8)) for i in range(60)]
    text = "-" * 300 + prose(7, 8) + " " + prose(99, 50)
    whole = d.Block(items).hits(text)
    monkeypatch.setattr(d, "POSTINGS", 500)
    assert d.Block(items).hits(text) == whole and 7 in {x[0] for x in whole}


def test_item_longer_than_a_run(prose, monkeypatch):
    r = random.Random(5)
    item = prose(4, 400)
    monkeypatch.setattr(d, "RUN_CHARS", 500)
    text = prose(5, 300) + " " + edited(r, item, 20) + " " + prose(6, 300)
    (got,) = d.Block([(3, item)]).hits(text)
    assert got[0] == 3 and got[3] <= 20 and brute(item, text[got[1] : got[2]]) == got[3]


def test_items_below_q(prose):
    block = d.Block([(1, "zebra"), (2, "zeb"), (3, "  "), (4, "Qu x"), (5, "zebra")])
    assert block.hits("a ZEBRA, here") == [(1, 2, 7, 0), (5, 2, 7, 0)]
    assert block.hits("zebras and azebra") == [] and block.hits("") == []


def test_time_grows_with_the_band(prose):
    """Rows of the table are as wide as the band, so a text beyond it costs nothing."""
    import time

    r = random.Random(6)
    item = d.plain(prose(1, 600))
    text = d.plain(prose(2, 20_000) + edited(r, prose(1, 600), 30) + prose(3, 20_000))
    at = next(low for j, low, high in d.Block([(1, prose(1, 600))]).regions(text))
    k = d.edits_allowed(len(item))
    began = time.perf_counter()
    got = d.align(item, text, k, at, at + 2 * (k + 1) - 1)
    assert got and got[0] <= 30 and time.perf_counter() - began < 1
