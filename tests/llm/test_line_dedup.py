import random

import numpy as np

import cladespark.llm.line_dedup as module
from cladespark.llm.line_dedup import band_keys, key_of, line_dedup, normal, similarity


def shingles(line):
    return {line[k : k + 8] for k in range(len(line) - 7)} if len(line) >= 8 else {line}


def brute(docs):
    lines = sorted({normal(x) for _, t in docs for x in (t or "").split("\n")} - {""})
    sets, parent = [shingles(x) for x in lines], list(range(len(lines)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if len(s & sets[j]) >= 0.75 * len(s | sets[j]):
                parent[root(i)] = root(j)
    group = {x: root(k) for k, x in enumerate(lines)}
    seen, out = set(), []
    for d, t in sorted(docs):
        kept = []
        for x in (t or "").split("\n"):
            g = group.get(normal(x))
            if g is None or g not in seen:
                kept.append(x)
            seen.add(g)
        out.append((d, len((t or "").split("\n")), len((t or "").split("\n")) - len(kept), "\n".join(kept)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join("".join(rng.choice("abcdefghijklé") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(1, 25))) for _ in range(40)]
    docs = []
    for k in range(60):
        lines = []
        for _ in range(rng.randint(0, 8)):
            line = rng.choice(base) if rng.random() < 0.7 else f"line {rng.random()} of its own"
            if rng.random() < 0.3 and len(line) > 60:
                at = rng.randrange(len(line))
                line = line[:at] + rng.choice("XYZ") + line[at + 1 :]
            lines.append(rng.choice(["", " "]) + line.upper() if rng.random() < 0.2 else line)
        docs.append((k, "\n".join(lines)))
    docs += [(100, None), (101, ""), (102, "\n \n"), (103, "short\nshort\nShort "), (104, "q" * 100000), (105, "q" * 100000 + "z")] + [(200 + k, base[0] + "\nthe hot line\n") for k in range(60)]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, key int").repartition(4)
    assert sorted(map(tuple, line_dedup(frame).collect())) == brute(docs)
    assert line_dedup(frame.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    """Rows that repeat an id hold lines of their own; null ids come last."""
    docs = [(1, "one line of some length here\nshared line of some length"), (1, "shared line of some length\nanother line of some length"), (None, "another line of some length\none line of some length here"), (None, None)]
    got = sorted(map(tuple, line_dedup(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()), key=str)
    assert sum(n for _, n, _, _ in got) == 7 and sum(g for _, _, g, _ in got) == 3
    kept = [x for *_, text in got for x in text.split("\n") if x]
    assert sorted(kept) == ["another line of some length", "one line of some length here", "shared line of some length"]
    assert [(n, g) for d, n, g, _ in got if d is None] == [(1, 0), (2, 2)]


def test_many_repeated_lines_in_one_text(spark):
    docs = [(1, "the very same line of text\n" * 100_000), (2, "the very same line of text")]
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert (got[1].n_lines, got[1].n_dropped, got[2].kept_text) == (100_001, 99_999, "")


def test_similarity_and_recall():
    rng = random.Random(5)
    near = found = 0
    for _ in range(400):
        a = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(9, 200)))
        b = list(a)
        for _ in range(rng.randint(0, max(1, len(a) // 40))):
            b[rng.randrange(len(b))] = "z"
        b = "".join(b)
        s, t = shingles(a), shingles(b)
        assert similarity(a, b) == len(s & t) / len(s | t)
        if similarity(a, b) >= 0.75:
            x, y = band_keys([a, b])
            near, found = near + 1, found + bool(np.any(x == y))
    assert near > 100 and found >= 0.99 * near


def test_large_family_of_templates(spark):
    rng = random.Random(7)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    head, foot, lines = some(50), some(57), []
    for _ in range(150):
        field = some(11)
        lines += [head + field + foot, head + field[:7] + some(4) + foot]
    a, b, c = lines[:3]
    assert similarity(a, b) > 0.75 > similarity(a, c) > 0.7
    rng.shuffle(lines)
    docs = [(k, "\n".join(lines[3 * k : 3 * k + 3])) for k in range(100)]
    assert sorted(map(tuple, line_dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect())) == brute(docs)


def test_pairs_of_cells_are_compared_in_blocks(spark):
    """Links between cells of a region of many blocks, of which no pair of lines is ever a row."""
    rng = random.Random(9)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    head, foot = some(50), some(57)
    lines = []
    for _ in range(300):
        field = some(11)
        lines += [head + field + foot, head + field[:7] + some(4) + foot]
    lines += [head + foot, "z" * 70000, "z" * 70000 + some(9)]
    key = {key_of(x): x for x in lines}
    rows = [(r, k, k) for r in (1, 2) for k in key]
    members, texts = spark.createDataFrame(rows, "region long, key long, c long"), spark.createDataFrame(list(key.items()), "key long, line string")
    got = {tuple(r) for r in module._linked_in_blocks(members, texts).collect()}
    sets = {k: shingles(x) for k, x in key.items()}
    want = {(a, b) for a in key for b in key if a < b and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])}
    assert got == want and len(want) >= 300


def test_small_groups_are_compared_together():
    rng = random.Random(11)
    lines, many = [], []
    for _ in range(50):
        base = "".join(rng.choice("abcdef ") for _ in range(rng.randint(9, 150)))
        own = list(dict.fromkeys(base[: (at := rng.randrange(len(base)))] + rng.choice("XYZ") * rng.randint(0, 3) + base[at:] for _ in range(rng.randint(1, 16))))
        lines += own
        many.append(len(own))
    cells = np.array([rng.randrange(3) for _ in lines])
    x, y = module._between_few(lines, many, cells)
    group, sets = np.repeat(np.arange(len(many)), many), [shingles(v) for v in lines]
    want = {(i, j) for i in range(len(lines)) for j in range(i) if group[i] == group[j] and cells[i] != cells[j] and len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j])}
    assert {(max(p), min(p)) for p in zip(x.tolist(), y.tolist(), strict=True)} == want and len(want) > 50
