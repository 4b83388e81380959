"""run() against a plain Python version, on planted documents."""

import itertools
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

import corpus_pipeline

SYLLABLES = ["th", "en", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "ou", "ea", "ti", "or"]
BAD = ["scummy", "mucky", "puggly", "bljk"]  # letters that no clean word has


def some_words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 5))) for _ in range(n)]


def planted(toxic=True):
    """(doc_id, text) and (item_id, text): clean, toxic, repeated-line, near-copy and benchmark documents."""
    rng = random.Random(12)
    items = [(i, " ".join(some_words(rng, n))) for i, n in enumerate((20, 40, 90))]
    again, docs = some_words(rng, 14), []
    for i in range(100, 500):
        words = some_words(rng, 90)
        kind = i % 20
        if toxic and kind % 4 == 0:
            for _ in range(12):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        lines = [words[:40], words[40:]]
        if kind == 1:
            lines.insert(rng.randrange(3), again)
        elif kind == 2:
            lines.insert(1, [*again[:5], *some_words(rng, 1), *again[6:]])  # one word changed
        elif kind == 3:
            lines.insert(1, [*again[:5], *some_words(rng, 3), *again[8:]])  # too many changed
        elif kind in (5, 6):
            item = items[i // 20 % 3][1].split()
            for at in range(0, len(item), 8 if kind == 5 else 3):  # an eighth, a third
                item[at] = some_words(rng, 1)[0]
            lines[0][20:20] = item
        elif kind == 7:
            lines = [words]
            docs.append((1000 + i, " ".join([*words[:30], *some_words(rng, 2), *words[32:]])))
        elif kind == 9:
            lines = [words]
            docs.append((2000 + i, " ".join(some_words(rng, 30) + words[30:])))  # too far
        docs.append((i, "\n".join(" ".join(x) for x in lines)))
    docs += [(600, None), (601, ""), (602, " ".join(again)), (603, docs[0][1])]
    return docs, items


def repeated_ids():
    """Id 3 stands for X and Z, 5 has a copy of X, and 1 one of Z."""
    rng = random.Random(13)
    x, z = some_words(rng, 90), some_words(rng, 90)
    near = [[*w[:30], *some_words(rng, 2), *w[32:]] for w in (x, z)]
    return [(3, " ".join(x)), (3, " ".join(z)), (5, " ".join(near[0])), (1, " ".join(near[1])), (4, None)]


def small_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_lines(docs):
    earlier, out = [], []
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            w = line.split()
            if len(w) < 8 or not any(small_edit(w, e) for e in earlier):
                kept.append(line)
            if len(w) >= 8:
                earlier.append(w)
        if len(kept) == len(lines) or "".join(kept).strip():
            out.append((doc_id, text if len(kept) == len(lines) else "\n".join(kept)))
    return out


def plain_groups(docs):
    rows = sorted(docs, key=lambda d: d[0])
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for _, t in rows]
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0:
            group = [group[a] if g == group[b] else g for g in group]
    kept = {}
    for i, row in enumerate(rows):
        kept.setdefault((group[i], None if sets[i] else i), row)
    return list(kept.values())


def plain_leak(text, item):
    doc, w = (text or "").split(), item.split()
    row = [0] * (len(doc) + 1)
    for i, x in enumerate(w, 1):
        last, row = row, [i]
        for j, y in enumerate(doc, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return min(row) <= len(w) // 5


def test_run_equals_a_plain_version(spark, tmp_path):
    docs, items = planted()
    toxic = {i for i, t in docs if set((t or "").split()) & set(BAD)}
    for name, rows, schema in (
        ("documents", [(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long"),
        ("benchmark", items, "item_id long, text string"),
        ("labels", [(i, 1, int(i in toxic)) for i, _ in docs], "doc_id long, quality int, toxic int"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    stages = [[d for d in docs if d[0] not in toxic]]
    stages.append(plain_lines(stages[-1]))
    stages.append(plain_groups(stages[-1]))
    stages.append([d for d in stages[-1] if not any(plain_leak(d[1], t) for _, t in items)])
    assert all(set(a) - set(b) for a, b in itertools.pairwise([docs, *stages]))  # every stage has what to do
    library = Library.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = [(i, len(t or ""), library.encode(t or "", add_special_tokens=False).ids) for i, t in stages[-1]]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, *_ in wanted)
    assert sorted((r["doc_id"], r["n_chars"], r["ids"]) for r in got) == sorted(wanted)
    assert all(r["decodes"] and r["n_tokens"] == len(r["ids"]) for r in got)


@pytest.mark.parametrize("repeats", [1, 2])
def test_rows_of_one_id_are_told_apart(spark, repeats):
    docs = repeated_ids()
    df = spark.createDataFrame(docs * repeats, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.one_of_each_group(spark, df, "").collect()]
    assert sorted(got) == sorted([docs[0], docs[3], docs[4]])
