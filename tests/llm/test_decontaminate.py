import hashlib
import random
import re

import pytest

from innings_engine.llm import decontaminate as dc


def cut(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)


def slow_report(texts, items, window):
    windows = {}
    for item, text in items:
        w = cut(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = {}
    for d, t in texts.items():
        w, hit, ids = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    ids |= windows[tuple(w[i:i + n])]
        ids.discard(None)
        listed = ",".join(sorted(map(str, ids)))
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(listed.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out, windows


def case(seed, letters, window, short):
    rng = random.Random(seed)
    some = lambda n: " ".join(rng.choice(letters) for _ in range(n))
    items = [(i, some(rng.choice([*short, window, window + 5, 3 * window]))) for i in range(15)] + [(50, None), (51, ""), (52, " .,-")]
    items += [(60, items[0][1]), (61, items[3][1] + " " + items[4][1]), (0, "Éa " + items[1][1])]
    texts = [None, "", "...", "A", some(3)]
    for _ in range(40):
        bits = [some(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            source = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, 3)
            bits += [" ".join(source[a:a + rng.randint(window - 2, 2 * window)]).upper().replace(" ", ", "), some(rng.randint(0, 400))]
        texts.append(" ".join(bits))
    return texts, items


@pytest.mark.parametrize("seed,letters,window,short", [(1, [f"w{i}" for i in range(40)], 13, [2, 5]), (2, "ab", 5, [1, 3]), (3, [f"w{i}é" for i in range(9)], 4, [4]), (4, "abc", 13, [12])])
@pytest.mark.parametrize("block_bytes", [1 << 20, 150])
def test_report_against_all_windows(spark, make_docs, seed, letters, window, short, block_bytes):
    texts, items = case(seed, letters, window, short)
    want, _ = slow_report(dict(enumerate(texts)), items, window)
    got = dc.contamination_report(make_docs(texts), spark.createDataFrame(items, "item_id long, text string"), window, block_bytes=block_bytes).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == want
    assert any(v[1] for v in want.values())


def test_spans_go_and_contaminated_rows_go(spark, make_docs):
    item = " ".join(f"q{i}" for i in range(13))
    filler = " ".join(f"f{i}" for i in range(400))
    docs = make_docs([f"Start, {item}! {filler}", item, filler, None, f"{item} x {item}"])
    items = spark.createDataFrame([(7, item.upper())], "item_id long, text string")
    for bytes_ in (1 << 20, 5):
        got = {r.doc_id: r.text for r in dc.decontaminated(docs, items, block_bytes=bytes_).collect()}
        assert got == {0: f"Start, ! {filler}", 2: filler, 3: None}


def test_empty_tables(spark, make_docs):
    items = spark.createDataFrame([(7, "a b")], "item_id long, text string")
    assert dc.contamination_report(make_docs(["a"]).where("false"), items).collect() == []
    none = items.where("false")
    assert [r.contaminated for r in dc.contamination_report(make_docs(["a", None]), none).collect()] == [False, False]
    assert dc.decontaminated(make_docs(["a", None]), none).count() == 2


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_null_and_repeated_ids_are_rows_of_their_own(spark, make_docs, block_bytes):
    first, second = (" ".join(f"{c}{i}" for i in range(13)) for c in "pq")
    filler = " ".join(f"f{i}" for i in range(400))
    texts, ids = [first, f"{filler} one", f"{second} {filler}", first, filler, filler, second], [None, None, 4, 4, 4, 4, None]
    items = spark.createDataFrame([(1, first), (2, second), (3, "x y z")], "item_id long, text string")
    docs = make_docs(texts, ids=ids).selectExpr("*", "'c' AS digest", "1 AS times", "2 AS col", "true AS gone")
    assert block_bytes > 1000 or len(list(dc.item_blocks(items, block_bytes))) > 1
    rows = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in dc.contamination_report(docs, items, block_bytes=block_bytes).collect()]
    want = [(None, 13, 13, 1, True), (None, 401, 0, 0, False), (4, 413, 13, 1, False), (4, 13, 13, 1, True), (4, 400, 0, 0, False), (4, 400, 0, 0, False), (None, 13, 13, 1, True)]
    key = lambda r: str(r)
    assert sorted(rows, key=key) == sorted(want, key=key)
    left = dc.decontaminated(docs, items, block_bytes=block_bytes)
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=key) == sorted([(None, f"{filler} one"), (4, f" {filler}"), (4, filler), (4, filler)], key=key)
