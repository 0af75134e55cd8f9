import collections
import hashlib
import itertools
import math
import random
import re
import time

import numpy as np
import pytest
import regex
import xxhash

from tabsplit.llm import lines, neardup, repeats
from tabsplit.operators import components as graph

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


class Sets:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def copies(seed, n=24):
    """Texts with exact, near and nearly near copies, shared passages and repeats within a text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for _ in range(n):
        base = [word() for _ in range(rng.randint(3, 120))]
        rows.append("\n".join(" ".join(base[k : k + 12]) for k in range(0, len(base), 12)))
        for edits in (0, 1, 3, 9):
            changed = list(base)
            for _ in range(min(edits, len(base))):
                changed[rng.randrange(len(base))] = word()
            rows.append("\n".join(" ".join(changed[k : k + 12]) for k in range(0, len(changed), 12)))
        if rng.random() < 0.4:
            rows.append(f"{rows[-1]}\n{passage}\n{word()} {passage}")
    return [(k, text) for k, text in enumerate(rows)]


def near_components(rows, width, percent):
    sets = []
    for doc_id, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append((doc_id, frozenset(zip(*(w[k:] for k in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else [])))
    linked = Sets(d for d, _ in sets if d is not None)
    for (a, s), (b, t) in itertools.combinations(sets, 2):
        if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
            linked.join(a, b)
    return sorted((d if d is not None else -1, len(s), linked.find(d) if d is not None else -1) for d, s in sets)


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(documents, odd_rows, width, percent):
    rows = copies(1) + [(None if d is None else 10_000 + d, t) for d, t, *_ in odd_rows]
    found = neardup.near_duplicates(documents(rows), width, percent).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in found) == near_components(rows, width, percent)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in found)


def test_blocks_of_a_posting_lose_no_link(documents, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "CHUNK", 400)
    monkeypatch.setattr(neardup, "TIES", 1)
    rows = copies(2, 6) + family(3, 30)
    found = neardup.near_duplicates(documents(rows), 3, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == near_components(rows, 3, 85)


def family(seed, n, first=5000):
    """Near copies of one text, of which some are linked with each other and others are not."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for k in range(n):
        changed = list(base)
        for _ in range(rng.randint(0, 9)):
            changed[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((first + k, " ".join(changed)))
    return rows


def test_ids_that_share_two_texts_with_near_copies(documents):
    rng = random.Random(4)
    rows = []
    for k in range(0, 200, 10):
        a, b = ([f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(2))
        rows += [(k + 1, " ".join(a)), (k + 1, " ".join(b)), (k + 3, " ".join(a[1:])), (k + 4, " ".join([*b, "more"])), (k + 1, None)]
    found = neardup.near_duplicates(documents(rows), 5, 80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == near_components(rows, 5, 80)
    assert all(r.component_id == r.doc_id // 10 * 10 + 1 for r in found)


def test_threshold_misses_at_most_one_in_a_million():
    for similarity in (0.8, 0.85, 0.9):
        t, p = neardup.threshold(similarity), similarity**neardup.ROWS
        below = [sum(math.comb(neardup.COORDINATES, k) * p**k * (1 - p) ** (neardup.COORDINATES - k) for k in range(n)) for n in (t, t + 1)]
        assert below[0] <= neardup.MISSED < below[1]


def removed_bytes(rows):
    counts = collections.Counter()
    data = [(d, (t or "").encode()) for d, t, *_ in rows]
    for _, b in data:
        counts.update(b[k : k + 200] for k in range(len(b) - 199))
    out = []
    for d, b in data:
        mark = np.zeros(len(b) + 1, dtype=int)
        for k in range(len(b) - 199):
            if counts[b[k : k + 200]] > 1:
                mark[k] += 1
                mark[k + 200] -= 1
        gone = np.cumsum(mark)[: len(b)] > 0
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone])
        out.append((d if d is not None else -1, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats_against_all_windows(documents, odd_rows):
    small = [r for r in odd_rows if len(r[1] or "") < 60_000 or r[0] == 6]
    rows = copies(3) + [(None if d is None else 10_000 + d, t) for d, t, *_ in small] + [(20_000, "ab" * 400), (20_001, "z" * 199), (20_002, "q" * 201)]
    found = repeats.without_repeats(documents(rows)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == removed_bytes(rows)


@pytest.mark.parametrize("crowded", [1, 30])
def test_repeats_are_the_same_for_any_bound_of_crowded_keys(documents, monkeypatch, crowded):
    monkeypatch.setattr(repeats, "CROWDED", crowded)
    rows = copies(8, 10)
    rows += [(1000 + k, rows[4][1]) for k in range(30)] + [(2000 + k, f"{k} " * 40 + rows[9][1]) for k in range(30)]
    found = repeats.without_repeats(documents(rows)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == removed_bytes(rows)


def test_many_contexts_of_one_passage(documents):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefghij ") for _ in range(260))
    rows = [(k, "".join(rng.choice("klmnop") for _ in range(300)) + passage + "".join(rng.choice("qrstuv") for _ in range(k))) for k in range(40)]
    found = repeats.without_repeats(documents(rows)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == removed_bytes(rows)


def test_loser_tree_merges_and_tells_common_prefixes():
    rng = random.Random(7)
    runs = [sorted((b"p" * rng.randint(0, 3) + bytes(rng.choices(b"ab", k=rng.randint(0, 6))), b"", 1, 1, k) for k in range(rng.randint(0, 40))) for _ in range(5)]
    merged = list(repeats.LoserTree([repeats.decoded(repeats.front_coded(r)) for r in runs]))
    suffixes = [m[1] for m in merged]
    assert suffixes == sorted(x[0] for r in runs for x in r)
    assert all(b[0] == repeats.common(a[1], b[1]) for a, b in itertools.pairwise(merged))


def norm(line):
    spaced = re.sub("[\u4e00-\u9fff]", lambda m: f" {m[0]} ", line.lower())
    return " ".join(x for x in regex.split(r"[^\p{L}\p{N}]+", spaced) if x) or " ".join(line.split())


def block_keys(words):
    hashes = {xxhash.xxh64_intdigest(w.encode()) for w in words}
    keys = []
    for j in range(lines.BLOCKS):
        mine = [h for h in hashes if (h >> 56) % lines.BLOCKS == j]
        bits = sum(1 << b for b in range(lines.BITS) if 2 * sum(h >> b & 1 for h in mine) > len(mine))
        keys.append((bits, min(len(mine), lines.MOST_TOLD)))
    return keys


def postings(words):
    keys, found = block_keys(words), set()
    for blocks, held, least, most in lines.POSTED:
        if max(least, lines.LEAST_WORDS) <= len(words) <= (most or len(words)):
            found |= {(chosen, *(keys[j] for j in chosen)) for chosen in itertools.combinations(range(lines.BLOCKS), blocks) if sum(keys[j][1] for j in chosen) >= held}
    return found


def alike(a, b):
    longest = max(len(a), len(b))
    return edits(a, b) <= int(longest * (1 - lines.SIMILAR) + 1e-9)


def brute_lines(rows):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    classes, places = {}, []
    for k in order:
        for n, line in enumerate(rows[k][1].split("\n") if rows[k][1] is not None else []):
            if x := norm(line):
                classes.setdefault(x, len(classes))
                places.append((k, n, x))
    names = list(classes)
    keys = [postings(x.split(" ")) for x in names]
    linked = Sets(range(len(names)))
    for i, j in itertools.combinations(range(len(names)), 2):
        if keys[i] & keys[j] and alike(names[i], names[j]):
            linked.join(i, j)
    seen, gone = set(), collections.defaultdict(set)
    for k, n, x in places:
        if (g := linked.find(classes[x])) in seen:
            gone[k].add(n)
        seen.add(g)
    return sorted((r[0] if r[0] is not None else -1, "\n".join(x for n, x in enumerate((r[1] or "").split("\n")) if n not in gone[k])) for k, r in enumerate(rows))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("met", [lines.MET, 2])
def test_lines_against_all_pairs(documents, monkeypatch, met):
    monkeypatch.setattr(lines, "MET", met)
    rng = random.Random(11)
    base = [" ".join(rng.choice(["red", "blue", "green", "deep", "old", "new", "house", "river", "stone"]) + str(rng.randint(0, 9)) * (rng.random() < 0.1) for _ in range(rng.choice([1, 2, 4, 10, 30, 140]))) for _ in range(30)]
    vary = lambda x: rng.choice([x, x.upper(), f"{x}!", f"{x} 77", x + "s", x.replace("red", "rot", 1), f"  {x}"])
    rows = [(k, "\n".join(vary(rng.choice(base)) for _ in range(rng.randint(0, 6)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "1 2 3 4\n1 2 3 4"), (None, base[2]), (104, "Read more\n---\n***"), (105, "read more\n---"), (106, "我们今天去公园里散步"), (107, "我们今天去公园里跑步吧\n我们今天去公园里散步。")]
    found = lines.without_repeated_lines(documents(rows)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in found) == brute_lines(rows)


def test_recall_against_edit_similarity_alone():
    """Of pairs of lines with an edit similarity of 0.8 or more, made by changes of letters or words, how many share a posting."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    met = collections.defaultdict(list)
    for _ in range(3000):
        a = [word() for _ in range(rng.randint(4, 60))]
        b = list(a)
        changes = rng.randint(1, 3)
        for _ in range(changes):
            k = rng.randrange(len(b))
            b[k : k + 1] = rng.choice([[b[k] + "s"], [word()], [b[k], word()], []])
        if b and alike(" ".join(a), " ".join(b)):
            met[changes].append(bool(postings(a) & postings(b)) or a == b)
    share = {n: sum(x) / len(x) for n, x in met.items()}
    assert share[1] > 0.95 and share[2] > 0.5, share


def test_extra_columns_with_clashing_names(documents):
    rows = [(1, "one line here\nand another line there"), (2, "one line here")]
    from pyspark.sql import functions as F

    names = ["places", "_doc_id", "gone_id", "row", "emptied", "n_removed", "n_lines", "key", "posting", "node", "label"]
    docs = documents(rows).withColumns({c: F.lit("mine") for c in names})
    found = lines.kept_rows(docs)
    assert found.columns == docs.columns
    assert [(r.doc_id, r.text, r.row, r.places) for r in found.collect()] == [(1, rows[0][1], "mine", "mine")]
    assert {r.doc_id: r.n_removed for r in lines.without_repeated_lines(docs).collect()} == {1: 0, 2: 1}


def test_line_of_very_many_words(documents):
    text = " ".join("".join(random.Random(k).choices("abcdefghijklmnop", k=6)) for k in range(20_000))
    found = lines.without_repeated_lines(documents([(1, text), (2, text)])).collect()
    assert sorted((r.doc_id, r.text == text, r.emptied) for r in found) == [(1, True, False), (2, False, True)]


def test_empty_tables(documents):
    empty = documents([(1, "x")]).where("false")
    assert neardup.near_duplicates(empty).count() == 0
    assert repeats.without_repeats(empty).count() == 0
    assert lines.without_repeated_lines(empty).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 200 + k) for k in range(30)] + [(300, 300)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {k: 0 for k in range(61)} | {100: 100} | {200 + k: 100 for k in range(30)}


def line_family(n):
    """One line of 30 words n times with one word changed; every other one has three more words changed, the same in all."""
    rng = random.Random(21)
    base = [f"word{k}" for k in range(30)]
    rows = []
    for k in range(n):
        changed = [f"second{j}" if k % 2 and j < 3 else w for j, w in enumerate(base)]
        changed[rng.randrange(3, 30)] = f"other{rng.randrange(10**6)}"
        rows.append((k, " ".join(changed)))
    return rows


def test_near_lines_of_a_large_family_are_not_compared_in_all_pairs(documents, monkeypatch):
    rows, compared, link = line_family(150), [], lines.linked
    monkeypatch.setattr(lines, "linked", lambda *x: compared.append(x[-1].count()) or link(*x))
    found = lines.without_repeated_lines(documents(rows)).collect()
    assert sorted((r.doc_id, r.text or "") for r in found) == brute_lines(rows)
    assert sum(compared) <= 3 * len(rows), compared


def test_lines_of_pairs_are_looked_up_once(documents, monkeypatch):
    rows, names, write = line_family(60), [], lines.written
    monkeypatch.setattr(lines, "written", lambda df, name: names.append(name) or write(df, name))
    found = lines.without_repeated_lines(documents(rows)).collect()
    assert sorted((r.doc_id, r.text or "") for r in found) == brute_lines(rows)
    assert names.count("lines") == 1 and names.count("links") > 2, names


def test_components_without_links_take_no_round(spark, monkeypatch):
    names, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: names.append(name) or write(df, name))
    assert graph.components(spark.createDataFrame([(7, 7)], "u long, v long")).count() == 0
    assert names == ["stars", "components"]


def test_line_dedup_runs_no_python(spark, documents, monkeypatch):
    plans, write = [], lines.written
    monkeypatch.setattr(lines, "written", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or write(df, name))
    found = lines.without_repeated_lines(documents(copies(5, 3)))
    assert not [x for x in [*plans, found._jdf.queryExecution().toString()] if "Arrow" in x or "Python" in x]


def test_edit_similarity_of_lines_against_all_of_their_letters(spark):
    rng, pairs = random.Random(22), []
    for _ in range(400):
        a = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))]
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 1)] = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))] * rng.randint(0, 1)
        pairs.append((" ".join(a), " ".join(b or ["x"])))
    found = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lines.alike("a", "b").alias("near")).collect()
    assert [r.near for r in found] == [alike(r.a, r.b) for r in found] and {r.near for r in found} == {True, False}


def test_words_are_hashed_without_a_seed(spark):
    from pyspark.sql import functions as F

    words = ["a", "word", "longer than thirty-two bytes of a word, and more", "é日"]
    found = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64(F.lit(lines.UNSEEDED), "w").alias("h")).collect()
    assert {r.w: r.h & (1 << 64) - 1 for r in found} == {w: xxhash.xxh64_intdigest(w.encode()) for w in words}


def test_normalised_texts_have_the_lines_of_each_line(documents):
    signs = ["---", "- - -", "\u00a0*\u2003 *", "", " ", "\u00a0", "\t", "\r", "…", "=\x1c="]
    words = ["(a)b", " a", "a ", "-a-b-", "a  b", "a - b", "ΣΑΣ. Σ", "İstanbul ÉTÉ", "naïve—x", "1,000", "我们 走a走", "ไทย", "x\ry", "𝒜𝒷 c", "a_b", "한 글"]
    rows = list(enumerate(["\n".join(words), "\n".join(signs), "\n".join(x for pair in zip(words, signs, strict=False) for x in pair), "\n", "", None, "\n---\n", "only one", *words, *signs]))

    def told(raw):
        low = re.sub("[\u0e00-\u0eff\u4e00-\u9fff]", lambda m: f" {m[0]} ", raw.lower())
        found = [x for x in regex.split(r"[^\p{L}\p{N}]+", low) if x]
        whole = regex.sub(r"[\s\x1c-\x1f\x85\p{Z}]+", " ", raw).strip(" ")
        return (" ".join(found), False) if found else (whole, True)

    expected = sorted((k, n, *x) for k, text in rows if text is not None for n, raw in enumerate(text.split("\n")) if (x := told(raw))[0])
    assert sorted((r.doc_id, r.place, r.line, r.signs) for r in lines.occurrences(documents(rows)).collect()) == expected


def test_code_of_postings_is_small_enough_to_be_compiled(spark, documents):
    classes = lines.written(lines.line_classes(lines.occurrences(documents(copies(6, 2)))), "classes")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        code = lines.posted(classes)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    # the JVM leaves methods beyond 8000 bytes to its interpreter
    assert 0 < max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000


def test_line_dedup_leaves_no_shuffle_files(spark, documents):
    key, disk = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before, rows = spark.conf.get(key, None), documents(line_family(20))

    def left():
        files = disk.getAllFiles()
        return {x for x in (files.apply(k).getName() for k in range(files.size())) if x.startswith("shuffle_")}

    kept = left()
    found = lines.removals(rows)
    until = time.monotonic() + 20
    while left() - kept and time.monotonic() < until:
        time.sleep(0.2)
    # lines of even and of odd documents are groups of their own
    assert not left() - kept and found.count() == 18
    assert spark.conf.get(key, None) == before


@pytest.mark.parametrize("sliced", [1, 7, 10_000])
def test_hot_anchors_that_have_another_in_their_slice_meet_no_join(documents, monkeypatch, sliced):
    monkeypatch.setattr(repeats, "CROWDED", 30)
    monkeypatch.setattr(repeats, "SLICED", sliced)
    kept, write = {}, repeats.written
    monkeypatch.setattr(repeats, "written", lambda df, name: kept.setdefault(name, write(df, name)))
    rows = copies(8, 6)
    rows += [(1000 + k, rows[4][1]) for k in range(30)] + [(2000 + k, f"{k} " * 40 + rows[9][1]) for k in range(30)]
    found = repeats.without_repeats(documents(rows)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == removed_bytes(rows)
    sizes = {r.here: r["count"] for r in kept["sliced"].groupBy("here").count().collect()}
    assert sum(sizes.values()) > 100 and (sliced < 10_000 or sizes.get(1, 0) < 0.5 * sum(sizes.values())), sizes
