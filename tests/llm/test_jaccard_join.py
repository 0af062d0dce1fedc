"""The Jaccard join against all pairs in plain Python."""

import re
from collections import Counter, defaultdict

import pytest
from cellweave.llm.jaccard_join import jaccard_components

SF = "/root/testdata/sf0.001"


def shingle_set(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0d]+", low)
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(texts, n, percent):
    sets = {i: shingle_set(t, n) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, x in sets.items():
        for g in x:
            holders[g].append(i)
    shared = Counter((max(a, b), min(a, b)) for ids in holders.values() for k, a in enumerate(ids) for b in ids[:k])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), k in shared.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("n", "percent"), [(5, 80), (3, 90)])
def test_documents(spark, n, percent):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, n, percent).collect()}
    assert got == brute(texts, n, percent)


def test_made_variants(spark):
    import random

    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, k = {}, 0
    for size in (1, 2, 3, 6, 12, 40, 150, 1500):
        base = [rng.choice(vocabulary) for _ in range(size)]
        for cuts in (0, 0, 1, 2, size // 40, size // 12):
            words = list(base)
            for _ in range(cuts):
                words[rng.randrange(size)] = rng.choice(vocabulary)
            texts[k] = " ".join(words)
            k += 1
    texts |= {k: None, k + 1: "", k + 2: " \t\n"}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, component string")
    for n, percent in ((5, 80), (3, 90)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, n, percent).collect()}
        assert got == brute(texts, n, percent)


def test_empty_table_and_null_key(spark):
    schema = "doc_id long, text string"
    assert jaccard_components(spark.createDataFrame([], schema)).count() == 0
    got = jaccard_components(spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f")], schema)).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in got) == [(False, 2), (True, None)]


def near_copies(count, size, seed):
    """Copies of one text with up to a seventh of the words changed: some link to one another, many don't."""
    import random

    rng = random.Random(seed)
    base = [f"b{i}" for i in range(size)]
    out = []
    for _ in range(count):
        words = list(base)
        for _ in range(rng.randrange(size // 7)):
            words[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("n", "percent", "most"), [(5, 80, 4096), (3, 90, 2), (1, 70, 4096)])
def test_large_group_of_near_copies(spark, monkeypatch, n, percent, most):
    """most: sets of a family that one task takes; larger families go by rounds."""
    from cellweave.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "WHOLE_SETS", most)
    texts = dict(enumerate(near_copies(150, 120, 1) + near_copies(60, 300, 2) + near_copies(60, 14, 3)))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, n, percent).collect()}
    assert got == brute(texts, n, percent)


def test_delta_links_alone_find_every_component(spark):
    """Families that no earlier step has looked at, against all pairs."""
    import random

    from cellweave.llm.components import connected_components
    from cellweave.llm.delta_links import delta_links, whole_links

    rng = random.Random(3)
    sets, rows = {}, []
    for fam in range(6):
        base = [rng.randrange(1 << 40) for _ in range(rng.choice([4, 20, 60]))]
        for k in range(rng.choice([2, 17, 70])):
            kept = [x for x in base if rng.random() > rng.choice([0, 0.02, 0.1])]
            xs = {*kept, *(rng.randrange(200) for _ in range(rng.randrange(4)))} or {1}
            if xs not in [s for (f, _), s in sets.items() if f == fam]:
                sets[fam, 1000 * fam + k] = xs
                rows.append((fam, 7 * k + 1, 1000 * fam + k, 1000 * fam + k, len(xs), list(xs)))
    level = spark.createDataFrame(rows, "fam long, w long, id long, c long, s long, xs array<long>")
    for percent, solve in ((60, delta_links), (90, delta_links), (60, lambda x, p: whole_links(x, p, 3)), (90, lambda x, p: whole_links(x, p, 3))):
        links = solve(level, percent)
        assert all(100 * len(a & b) >= percent * len(a | b) for a, b in ((sets[r.a // 1000, r.a], sets[r.b // 1000, r.b]) for r in links.collect()))
        found = {r.node: r.component for r in connected_components(links).collect()}
        parent = {i: i for _, i in sets}

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for f, i in sets:
            for g, j in sets:
                if f == g and i < j and 100 * len(sets[f, i] & sets[g, j]) >= percent * len(sets[f, i] | sets[g, j]):
                    x, y = root(i), root(j)
                    parent[max(x, y)] = min(x, y)
        assert {i: found.get(i, i) for _, i in sets} == {i: root(i) for _, i in sets}


def test_rounds_leave_behind_what_one_set_holds(spark, monkeypatch):
    """Tables of a round have no element that a single set of the family holds; they were shuffled and written with all others."""
    from cellweave.llm import delta_links as D
    from pyspark.sql import functions as F

    seen, write = {}, D.cut

    def noted(df, name="cut", *more):
        out = write(df, name, *more)
        if name in ("apart", "first"):
            seen[name] = max(seen.get(name, 0), out.agg(F.coalesce(F.sum(F.size("xs")) if name == "apart" else F.count("*"), F.lit(0))).first()[0])
        return out

    monkeypatch.setattr(D, "cut", noted)
    base = list(range(1000, 1003))
    sets = [(1, w, w, w, 103, base + [w, w // 2 + 500, *range(10**6 * (w + 1), 10**6 * (w + 1) + 98)]) for w in range(40)]
    sets += [(1, 99, 99, 99, 103, sets[7][5][:-3] + [1, 2, 3]), (1, 98, 98, 98, 9, base + [*range(50, 56)])]
    links = D.delta_links(spark.createDataFrame(sets, "fam long, w long, id long, c long, s long, xs array<long>"), 90)
    assert {(min(r), max(r)) for r in links.collect()} == {(7, 99)}
    assert 0 < seen["apart"] < 400
    assert seen["first"] < 400


@pytest.mark.parametrize("slot", [1 << 16, 4])
def test_rounds_write_differences_only(spark, monkeypatch, slot):
    """Nearly equal sets give a round their few differences; all that they hold was written, shuffled and joined with the consensus."""
    from cellweave.llm import delta_links as D

    rows, write = {}, D.cut

    def noted(df, name="cut", *more):
        out = write(df, name, *more)
        rows[name] = max(rows.get(name, 0), out.count())
        return out

    monkeypatch.setattr(D, "cut", noted)
    monkeypatch.setattr(D, "NUMBERED", slot)
    base = list(range(1000, 1300))
    # sets lack shared thirds of 90 elements, each with 30 own ones, so that few link; the last two differ by 2 of 300
    sets = [[x for x in base if not (w % 3) * 90 <= x - 1000 < (w % 3) * 90 + 60 + w] + list(range(10**4 * (w + 1), 10**4 * (w + 1) + 30)) for w in range(30)]
    sets += [base[:-1], base[1:]]
    table = [(1, w, w, w, len(xs), xs) for w, xs in enumerate(sets)]
    links = D.delta_links(spark.createDataFrame(table, "fam long, w long, id long, c long, s long, xs array<long>"), 90)
    got = {(min(r), max(r)) for r in links.collect()}
    linked = {(a, b) for b in range(32) for a in range(b) if 10 * len({*sets[a]} & {*sets[b]}) >= 9 * len({*sets[a]} | {*sets[b]})}
    assert (30, 31) in linked and got <= linked

    def parts(pairs):
        root = list(range(32))
        for a, b in [*pairs] * 32:
            root[a] = root[b] = min(root[a], root[b])
        return root

    assert parts(got) == parts(linked)
    away = sum(len({*base} ^ {*xs}) for xs in sets)
    assert 0 < rows["held"] < away < sum(map(len, sets)) / 2


def near_misses(groups, seed):
    """Texts of which three of a base share signatures but differ too much, and a fourth links to the third."""
    import random

    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"g{g}b{i}" for i in range(120)]
        for k in range(3):
            words = list(base)
            for at in (9 + 30 * k, 19 + 30 * k, 29 + 30 * k):
                words[at] = f"x{rng.randrange(10**9)}"
            out.append(" ".join(words))
        out.append(out[-1].replace(f"g{g}b115", "y"))
    return out


def test_small_groups_make_no_family(spark, monkeypatch):
    """Groups whose bitmaps leave few pairs open were chained to families, which grew faster than the input."""
    from cellweave.llm import jaccard_join as J

    def never(*_):
        raise AssertionError("a family was made")

    monkeypatch.setattr(J, "family_links", never)
    texts = dict(enumerate(near_misses(30, 4)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute(texts, 5, 80)


@pytest.mark.parametrize(("name", "value"), [("GROUP", 2), ("OPEN", 0), ("OPEN", 10**6)])
def test_groups_by_each_way(spark, monkeypatch, name, value):
    """Groups too large for a task, groups with more open pairs than are listed, and all pairs listed."""
    from cellweave.llm import jaccard_join as J

    monkeypatch.setattr(J, name, value)
    texts = dict(enumerate(near_copies(60, 120, 1) + near_copies(30, 14, 3)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute(texts, 5, 80)


def test_rounds_part_groups_by_their_own_classes(spark, monkeypatch):
    """A set of a large group had a row for each class of its family, of which its group holds few."""
    import random

    from cellweave.llm import delta_links as D

    rows, write = {"first": [], "large": []}, D.cut

    def noted(df, name="cut", *more):
        out = write(df, name, *more)
        rows.get(name, []).extend(out.collect() if name in rows else ())
        return out

    monkeypatch.setattr(D, "cut", noted)
    monkeypatch.setattr(D, "FEW", 2)
    rng = random.Random(8)
    sets = [[*range(1000, 1060 + 9 * (w % 5)), *rng.sample(range(60), 4 + 7 * (w % 6))] for w in range(40)]
    table = [(1, w, w, w, len(xs), xs) for w, xs in enumerate(sets)]
    D.delta_links(spark.createDataFrame(table, "fam long, w long, id long, c long, s long, xs array<long>"), 90)
    held = {(r.fam, r.x, r.own) for r in rows["first"]}
    assert rows["large"] and all((r.fam, r.x, r.other) in held for r in rows["large"])
