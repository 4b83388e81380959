"""Line dedup, Jaccard join, decontamination and fingerprints against brute force."""

import hashlib
import itertools
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkwell.llm import components, decontaminate, fingerprint, jaccard, line_dedup
from inkwell.llm.words import runs


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def noisy(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        at = rng.randrange(len(out))
        rng.choice([lambda: out.__setitem__(at, rng.choice("abcdefgh")), lambda: out.insert(at, rng.choice("abc")),
                    lambda: out.pop(at) if len(out) > 1 else None])()
    return out


def small_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.fixture(scope="module")
def lined():
    rng = random.Random(5)
    bases = [[rng.choice("abcdefghij") for _ in range(rng.randint(6, 30))] for _ in range(12)]
    rows = []
    for i in range(120):
        lines = [" ".join(noisy(rng, rng.choice(bases), rng.choice([0, 0, 1, 1, 2]))) for _ in range(rng.randint(0, 5))]
        rows.append((i, "\n".join(lines), "x"))
    return rows + [(120, None, "x"), (121, "\n\n", "x"), (122, rows[0][1], "y"), (122, rows[1][1], "z"), (None, rows[2][1], "w")]


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_line_dedup(spark, lined, small, monkeypatch):
    monkeypatch.setattr(line_dedup.duplicate_lines, "__defaults__", (small,))
    df = spark.createDataFrame(lined, "doc_id long, text string, line string")
    got = line_dedup.dedup_lines(df).collect()
    assert len(got) == len(lined)
    plain = [r for r in lined if r[0] != 122 and r[0] is not None]
    earlier = [(None, 0, tuple(words(line))) for line in lined[2][1].split("\n") if len(words(line)) >= 8]
    for doc_id, text, _ in sorted(plain):
        kept = []
        for line in (text or "").split("\n"):
            w = tuple(words(line))
            if len(w) < 8:
                kept.append(line)
                continue
            if not any(small_edit(w, e) for _, _, e in earlier):
                kept.append(line)
            earlier.append((doc_id, 0, w))
        row = next(r for r in got if r["doc_id"] == doc_id)
        assert row["text"] == (None if text is None else "\n".join(kept)), doc_id
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_rows_without_an_id_and_equal_rows_are_documents_of_their_own(spark):
    """Of near-equal lines in rows that share an id or have none, one stays, whatever their hashes."""
    rng = random.Random(11)
    rows = []
    for i in range(300):
        line = " ".join(rng.choice("abcdefghij") + str(i) for _ in range(10))
        own = " ".join(f"own{i}x{k}" for k in range(9))
        rows += [(None, f"{line}\n{own}a"), (None, f"{line} more\n{own}b\nshort line")]
    rows += [(7, "same row " * 4), (7, "same row " * 4), (None, "no id at all " * 3), (None, "no id at all " * 3)]
    got = [r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(rows)
    lines = [line for text in got for line in text.split("\n")]
    for i in range(300):
        assert sum(f" a{i} " in f" {line} " or re.search(rf"\b[a-j]{i}\b", line) is not None for line in lines) == 1
        assert sum(f"own{i}x0 " in line for line in lines) == 1
    assert lines.count("same row " * 4) == 1 and lines.count("no id at all " * 3) == 1
    assert lines.count("short line") == 300


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            root[find(b)] = find(a)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(
        ((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr
    )


def test_jaccard_components_of_rows_without_an_id(spark):
    rng = random.Random(2)
    bases = [[f"w{rng.randrange(300)}" for _ in range(60)] for _ in range(8)]
    rows = [(None if i % 3 else i, " ".join(noisy(rng, bases[i % 8], rng.choice([0, 1, 1, 2])))) for i in range(160)]
    rows += [(None, " ".join(bases[1])), (None, " ".join(bases[1])), (500, " ".join(bases[2])), (None, "only without ids here ok")]
    rows += [(None, "only without ids here ok"), (None, ""), (None, None), (3, rows[0][1]), (3, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for small in (1_000_000, 0):
        got = [tuple(r) for r in jaccard.jaccard_components(df, small=small).collect()]
        assert sorted(got, key=repr) == brute_components(rows)


@pytest.mark.parametrize("per_task", [10, 50_000])
def test_spanning_keeps_components_of_a_dense_group(spark, per_task, monkeypatch):
    monkeypatch.setattr(components, "LINKS_PER_TASK", per_task)
    rng = random.Random(4)
    pairs = [tuple(rng.sample(range(400), 2)) for _ in range(20_000)] + [(1000 + i, 1001 + i) for i in range(0, 60, 2)]
    links = spark.createDataFrame(pairs, "a long, b long")
    thin = components.spanning(links)
    assert thin.count() <= 2 * 460
    got = {r["node"]: r["root"] for r in components.connected(links).collect()}
    assert {got[i] for i in range(400)} == {0} and all(got[1001 + i] == 1000 + i for i in range(0, 60, 2))
    assert len(got) == 460


@pytest.mark.parametrize("per_task", [40, 50_000])
def test_components_of_long_chains(spark, per_task, monkeypatch):
    monkeypatch.setattr(components, "LINKS_PER_TASK", per_task)
    rng = random.Random(6)
    order = rng.sample(range(5000, 5300), 300)
    chains = [(i, i + 1) for i in range(500)] + list(zip(order[1:], order[:-1], strict=True))
    pairs = chains + [(9000, 9001), (9001, 9001), (9002, 9001)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {i: 0 for i in range(501)} | {i: 5000 for i in range(5000, 5300)} | {i: 9000 for i in range(9000, 9003)}
    assert got == want


@pytest.mark.parametrize("bucket, block", [(64, 1 << 22), (4, 400)])
def test_jaccard_components(spark, bucket, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BUCKET", bucket)
    rng = random.Random(9)
    bases = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(3, 90))] for _ in range(25)]
    rows = [(i, " ".join(noisy(rng, rng.choice(bases), rng.choice([0, 1, 1, 2, 3])))) for i in range(200)]
    rows += [(900 + i, " ".join(noisy(rng, bases[1], 2))) for i in range(150)]
    rows += [(300, ""), (301, None), (302, "A b"), (303, "a B"), (304, bases[0][0]), (5, rows[9][1]), (5, rows[5][1])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, n int")
    got = sorted((tuple(r) for r in jaccard.jaccard_components(df).collect()), key=repr)
    assert got == brute_components(rows)
    assert jaccard.jaccard_components(df, small=0).count() == len(rows)
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.range(300).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    assert {r["root"] for r in components.connected(links).collect()} == {0}


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"v{rng.randrange(300)}" for _ in range(rng.randint(8, 50)))) for i in range(60)]
    items += [(60, "two words"), (61, None), (62, ""), (63, items[0][1])]
    docs, wanted = [], {}
    for share in (0, 0.1, 0.2):
        for i, text in items[:60]:
            inner = text.split()
            for at in rng.sample(range(len(inner)), int(share * len(inner))):
                inner[at] = "changed"
            edge = [f"v{rng.randrange(300)}" for _ in range(30)]
            doc_id = len(docs)
            wanted[doc_id] = (share, i)
            docs.append((doc_id, " ".join([*edge, *inner, *edge]).replace(" v1", ", V1") + "!"))
    docs += [(500, None), (501, ""), (502, "Two Words."), (503, " ".join(f"u{k}" for k in range(400)))]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, leaks string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in decontaminate.find_leaks(df, bench).collect()}
    for share, least in ((0, 1.0), (0.1, 0.97), (0.2, 0.9)):
        hits = [i in got[d] for d, (s, i) in wanted.items() if s == share]
        assert sum(hits) / len(hits) >= least, share
    assert got[500] == got[501] == got[503] == [] and got[502] == [60] and {0, 63} <= set(got[0])
    assert decontaminate.find_leaks(df, bench.limit(0)).where("contaminated").count() == 0


def beside_the_bound(rng, base, edits):
    """Words changed, put in or left out at so many different places."""
    out = list(base)
    for at in sorted(rng.sample(range(len(base)), edits), reverse=True):
        new = f"x{rng.randrange(10**6)}"
        rng.choice([lambda: out.__setitem__(at, new), lambda: out.insert(at, new), lambda: out.pop(at)])()
    return out


@pytest.mark.parametrize("size", [30, 45, 60, 100, 200, 300])
def test_items_at_the_edit_bound_are_found(size):
    import numpy as np

    rng = random.Random(size)
    items = [[f"v{rng.randrange(3000)}" for _ in range(size)] for _ in range(100)]
    block = decontaminate.Block.of(list(range(100)), [" ".join(x) for x in items])
    edge = [[f"v{rng.randrange(3000)}" for _ in range(30)] for _ in range(100)]
    edits = decontaminate.most_edits(size)
    near = [beside_the_bound(rng, x, edits) for x in items]
    far = [[f"y{k}" if k % 3 == 0 else w for k, w in enumerate(x)] for x in items]  # a third of the words
    for inner, least, most in ((near, 0.96, 1.0), (far, 0, 0)):
        texts = [" ".join([*e, *x, *e]) for e, x in zip(edge, inner, strict=True)]
        (_, _, data, offsets), = runs(pa.array(texts))
        hashes, first = decontaminate.plain_words(data, offsets)
        got = block.leaks(hashes, first)
        assert least <= sum(i in [x[0] for x in g] for i, g in enumerate(got)) / len(got) <= most
        for i, spans in enumerate(got):
            for item, begin, end in spans:
                found = hashes[first[i] + begin : first[i] + end + 1]
                assert decontaminate.edit_distances(block.words[item], found)[-1] <= edits
                assert abs(begin - 30) <= edits and abs(end - 29 - len(inner[i])) <= edits


def test_pieces_cover_an_item():
    for size in range(decontaminate.MIN_WORDS, 400):
        pieces = decontaminate.pieces_of(size)
        assert [a + n for a, n in pieces] == [a for a, _ in pieces[1:]] + [size]
        assert all(decontaminate.MIN_WORDS <= n <= decontaminate.PIECE for _, n in pieces)
        # more edits than every piece allows are more than the item allows
        assert sum(decontaminate.most_edits(n) + 1 for _, n in pieces) > decontaminate.most_edits(size)


def test_edit_distances_equal_plain_ones():
    import numpy as np

    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 8))] for _ in range(2))
        table = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        assert decontaminate.edit_distances(np.array(a), np.array(b)).tolist() == table[-1]


def test_fingerprints(spark):
    rng = random.Random(8)
    rows = [(i * 3, " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randint(0, 900)))) for i in range(60)]
    rows += [(7, None), (8, ""), (10, "é" * 9), (11, rows[4][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, sketch string")
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_next(df).collect()}
    ordered = sorted(rows)
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        text, after = text or "", after or ""
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = (
            {tuple(x[k : k + 5]) for k in range(max(1, len(x) - 4))} if (x := t.lower().split()) else set()
            for t in (text, edited, after)
        )
        for near, other in (("near_edited", b), ("near_next", c)):
            true = len(a & other) / len(a | other) if a | other else 1.0
            assert abs(r[near] - true) < 0.35, (i, near)
    assert got[11]["fingerprint"] == got[12]["fingerprint"] and got[8]["fingerprint"] == ""
    one = fingerprint.fingerprint_next(df.where("doc_id = 0")).first()
    assert one["near_next"] == 1.0
    assert fingerprint.fingerprint_next(df.limit(0)).count() == 0
    again = fingerprint.fingerprint_next(df.unionByName(df.where("doc_id = 12"))).where("doc_id = 12").collect()
    assert len(again) == 2 and again[0] == again[1]


def test_runs_cut_and_words():
    texts = ["a b", "", None, "c" * 50, "d\u00a0e f"]
    seen = [(lo, hi) for lo, hi, _, _ in runs(pa.array(texts), 10)]
    assert seen[0][0] == 0 and seen[-1][1] == 5


def plain_hashes(text):
    """The upper 32 bits of every distinct shingle's hash, as signed numbers."""
    import xxhash

    w = words(text)
    spans = [w[i : i + 5] for i in range(len(w) - 4)] if len(w) >= 5 else [w] if w else []
    out = set()
    for span in spans:
        seed = 42
        for word in span:
            seed = xxhash.xxh64_intdigest(word.encode(), seed)
        high = seed >> 32
        out.add(high - (1 << 32) if high >= 1 << 31 else high)
    return out


def test_kept_hashes_are_all_those_below_the_threshold(spark):
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(900)}" for _ in range(n)) for n in (0, 1, 4, 5, 20, 60, 200, 900, 4000, 200_000)] + [None, "  "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for row in fingerprint.with_sketch(rows, "text", "sketch").collect():
        every = plain_hashes(row.text or "")
        below = sorted(h for h in every if h < fingerprint.THRESHOLD)
        assert row.sketch == (below if len(below) >= fingerprint.FLOOR else sorted(every)[: fingerprint.FLOOR])


def test_likeness_of_long_texts_is_close_to_the_true_one(spark):
    rng = random.Random(13)
    pairs = []
    for k in range(40):
        a = [f"w{rng.randrange(5000)}" for _ in range(3000)]
        at = rng.randrange(100, 2900)
        pairs.append((k, " ".join(a), " ".join(a[:at] + [f"v{rng.randrange(5000)}" for _ in range(3000 - at)])))
    df = fingerprint.with_sketch(spark.createDataFrame(pairs, "k int, x string, y string"), "x", "a")
    got = fingerprint.compare(fingerprint.with_sketch(df, "y", "b"), "a", "b", "like", "inside").collect()
    errors = []
    for row in got:
        a, b = plain_hashes(row.x), plain_hashes(row.y)
        errors += [row.like - len(a & b) / len(a | b), row.inside - len(a & b) / len(a)]
    assert max(map(abs, errors)) < 0.1 and abs(sum(errors) / len(errors)) < 0.02
