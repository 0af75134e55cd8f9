"""Line dedup: fuzzy lines by SimHash.

Lines are normalised to lower-case words of letters and numbers; a line without any stands for itself. Equal normalised lines
are one class, whatever their length. A class of LEAST_WORDS words or more has a SimHash of BLOCKS blocks. A word votes in one
block only, chosen by its hash, so that a changed word leaves the other blocks as they are: by the pigeonhole principle two
lines that differ in one word agree in three of the five blocks. Classes are posted under each choice of three blocks, long
ones under each choice of two; lines that share a posting, and whose lengths allow it, are candidates. Candidates whose edit
similarity is at least SIMILAR are linked, and of each connected group of lines the first occurrence, by doc_id and line, stays.

All steps are DataFrame functions. The words of a class are exploded where the class was gathered, so that its votes are summed
without a further shuffle. Postings of one class are dropped before any join. In the others every class is compared with a pivot
first, in rounds: those whose label differs from the pivot's meet the pivot of the next round. What is apart after the
rounds is compared with the classes of all other components, block by block where a posting is large.

Defined results: null texts have no lines; blank lines are left alone; rows that are equal in doc_id and text keep and lose the
same lines; a null doc_id comes first; documents with nothing to remove keep their text as it is; letters of scripts without
spaces are words of their own; an empty table gives an empty table; other columns stay, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsplit.functions.columns import let
from tabsplit.operators.components import components
from tabsplit.shared import dropped, swept, written

LEAST_WORDS, SIMILAR, BLOCKS = 3, 0.8, 5
#: Bits of a block that are voted on, and words of a block that its key tells apart.
BITS, MOST_TOLD = 24, 255
#: Blocks of a posting, words that they hold together at least, and the fewest and most words of the lines that are posted so.
POSTED = ((3, 2, LEAST_WORDS, 7), (3, 3, 6, 16), (3, 4, 14, 27), (2, 8, 24, None))
#: Classes of a block of a large posting; rounds of pivots at most, and the share of the first comparison's links that is few.
MET, ROUNDS, FEW = 4096, 4, 2
#: What is between words of a line, but for a single space; scripts that are written without spaces: Thai to Myanmar, and the East Asian ones;
#: signs from the first of these on; white space.
BETWEEN, UNSPACED = r"[^\p{L}\p{N}\n ][^\p{L}\p{N}\n]*| [^\p{L}\p{N}\n]+", r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\x{20000}-\x{3ffff}]"
HIGH = r"[\u0e00-\x{10ffff}]"
BLANK = r"\s\x1c-\x1f\x85\p{Z}"
KEYS = [f"b{j}" for j in range(BLOCKS)]
CLASS = ["key_a", "key_b"]
#: Its xxhash64 is 0, so that xxhash64(UNSEEDED, word) is the word's XXH64 with seed 0.
UNSEEDED = -365884300664092260


def normal(text: DataFrame) -> DataFrame:
    """The table with `line`, its texts in lower case with one space for what is between words of a line; breaks of lines stay.

    Steps are columns of their own, so that each is computed once a text.
    """
    low = text.withColumn("line", F.lower("text"))
    spaced = F.when((F.octet_length("line") > F.length("line")) & F.col("line").rlike(HIGH), F.regexp_replace("line", UNSPACED, " $0 ")).otherwise(F.col("line"))
    return low.withColumn("line", spaced).withColumn("line", F.regexp_replace("line", BETWEEN, " "))


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, place, class key, normalised line of every line that isn't blank, and whether it has signs only, which are one word.

    Texts are normalised whole; raw lines are looked at where a normalised one is empty. Of those, lines of signs stand behind a break.
    """
    texts = normal(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text"))
    signs = lambda raw: F.when(raw.rlike(f"[^{BLANK}]"), F.concat(F.lit("\n"), F.trim(F.regexp_replace(raw, f"[{BLANK}]+", " ")))).otherwise("")
    broken = F.concat(F.lit("\n"), F.col("line"), F.lit("\n"))
    empty = F.contains(broken, F.lit("\n\n")) | F.contains(broken, F.lit("\n \n"))
    both = F.zip_with(F.split("line", "\n"), F.split("text", "\n"), lambda line, raw: F.when(F.trim(line) == "", signs(raw)).otherwise(line))
    each = texts.select("doc_id", "text_key", F.posexplode(F.when(empty, both).otherwise(F.split("line", "\n"))).alias("place", "line"))
    told = each.select("doc_id", "text_key", "place", F.trim("line").alias("line"), F.startswith("line", F.lit("\n")).alias("signs")).where("line <> ''")
    told = told.withColumn("line", F.when(F.col("signs"), F.substr("line", F.lit(2))).otherwise(F.col("line")))
    return told.select("doc_id", "text_key", "place", F.xxhash64("line").alias("key_a"), F.xxhash64(F.lit(1), "line").alias("key_b"), "line", "signs")


def line_classes(found: DataFrame) -> DataFrame:
    """Class key, occurrences, first of them, length, number of words and block keys of every class.

    The words of a class are exploded in the task that gathered it; distinct words vote, so that a language's common ones don't
    outvote the others of a long line. Sums hold three votes each, of 21 bits: enough for any line whose words fit in a task's memory.
    """
    third = BITS // 3
    gathered = found.groupBy(CLASS).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "place")).alias("first"), F.first("line").alias("line"), F.first("signs").alias("signs"))
    kept = ["n", "doc_id", "text_key", "place", "length", "n_words"]
    split = gathered.select(*CLASS, "n", "first.*", F.length("line").alias("length"), F.split("line", " ").alias("words"), "signs")
    split = split.withColumn("n_words", F.when(F.col("signs"), 1).otherwise(F.size("words")))
    flat = split.select(*CLASS, *kept, F.explode_outer(F.when(F.col("n_words") >= LEAST_WORDS, F.array_distinct("words"))).alias("word"))
    hashed = flat.withColumn("h", F.when(F.col("word").isNotNull(), F.xxhash64(F.lit(UNSEEDED), "word")))
    part = lambda x, k, n: F.shiftrightunsigned(x, k).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
    bits = reduce(lambda p, q: p + q, (F.shiftleft(part("h", third * k, third), 21 * k) for k in range(3)))
    votes = hashed.select(*CLASS, *kept, (F.shiftrightunsigned("h", 56) % BLOCKS).alias("block"), bits.alias("bits"))
    sums = [F.sum(F.shiftrightunsigned("bits", k).bitwiseAND(F.lit(1 + (1 << 21) + (1 << 42)))).alias(f"v{k}") for k in range(third)]
    same = [F.max(c).alias(c) for c in kept]
    told = votes.groupBy(*CLASS, "block").agg(F.count("*").alias("held"), *sums, *same)
    above = [F.when(2 * part(f"v{k % third}", 21 * (k // third), 21) > F.col("held"), 1 << k).otherwise(0) for k in range(BITS)]
    key = F.least("held", F.lit(MOST_TOLD)) * (1 << BITS) + reduce(lambda p, q: p + q, above)
    keyed = told.select(*CLASS, *kept, "block", key.alias("key"))
    blocks = [F.coalesce(F.max(F.when(F.col("block") == j, F.col("key"))), F.lit(0)).cast("long").alias(b) for j, b in enumerate(KEYS)]
    told = keyed.groupBy(CLASS).agg(*blocks, *same)
    return told.select(*CLASS, "n", F.struct("doc_id", "text_key", "place").alias("first"), "length", "n_words", *KEYS)


def posted_by(classes: DataFrame, blocks: int) -> DataFrame:
    """key_a, length and posting of the classes under each choice of so many blocks.

    Each number of blocks is a step of its own: the code of all in one is too large for the JVM to compile.
    """
    held = F.coalesce(*(F.when((F.col("n_words") >= least) & (F.lit(True) if most is None else F.col("n_words") <= most), least_held) for n, least_held, least, most in sorted(POSTED, key=lambda x: x[1]) if n == blocks))
    told = classes.where(F.col("n_words") >= LEAST_WORDS).select("key_a", "length", *KEYS, held.alias("held")).where("held is not null")
    words = lambda j: F.shiftright(f"b{j}", BITS)
    keys = [F.when(reduce(lambda p, q: p + q, map(words, chosen)) >= F.col("held"), F.xxhash64(F.lit(sum(1 << j for j in chosen)), *(f"b{j}" for j in chosen))) for chosen in combinations(range(BLOCKS), blocks)]
    return told.select("key_a", "length", F.explode(F.array(*keys)).alias("posting")).where("posting is not null")


def posted(classes: DataFrame) -> DataFrame:
    """The postings of two or more classes: posting, key_a, length, and the posting's pivot and size."""
    dealt = reduce(DataFrame.union, (posted_by(classes, n) for n in sorted({x[0] for x in POSTED}))).repartition("posting")
    # the greatest length is asked for so that both sides can read one shuffle
    shared = dealt.groupBy("posting").agg(F.count("*").alias("size"), F.min("key_a").alias("pivot"), F.max("length").alias("longest")).where("size > 1 and longest > 0").drop("longest")
    return dealt.join(shared.hint("shuffle_hash"), "posting")


def fitting(a: Column | str, b: Column | str) -> Column:
    return F.least(a, b) >= SIMILAR * F.greatest(a, b)


def pivot_pairs(post: DataFrame) -> DataFrame:
    """(u, v): each class with that pivot of its postings that it meets most often, of those whose lengths allow a link."""
    met = post.where("key_a <> pivot").groupBy("key_a", F.col("pivot").alias("v")).agg(F.count("*").alias("n"), F.first("length").alias("length"))
    pivots = post.where("key_a = pivot").groupBy(F.col("key_a").alias("v")).agg(F.first("length").alias("of"))
    return most_met(met.join(pivots, "v").where(fitting("length", "of")))


def most_met(met: DataFrame, *more: str) -> DataFrame:
    return met.groupBy(F.col("key_a").alias("u")).agg(F.max(F.struct("n", "v", *more)).alias("x")).select("u", F.col("x.v").alias("v"), *(f"x.{c}" for c in more))


def labelled(post: DataFrame, labels: DataFrame) -> DataFrame:
    named = post.join(labels.select(F.col("node").alias("key_a"), F.col("label").alias("known")), "key_a", "left")
    return named.withColumn("label", F.coalesce("known", "key_a")).drop("known")


def shortened(labels: DataFrame) -> DataFrame:
    """node and label, of each node's label its own label where it has one."""
    on = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
    return labels.join(on, "label", "left").select("node", F.coalesce("next", "label").alias("label"))


def still_open(post: DataFrame, labels: DataFrame) -> DataFrame:
    """The postings whose classes have several labels, with label and `to`, the least class of the least label."""
    named = labelled(post.drop("label", "to"), labels)
    several = named.groupBy("posting").agg(F.max("label").alias("other"), F.min(F.struct("label", "key_a", "length")).alias("to")).where("to.label <> other").select("posting", "to")
    return named.join(several, "posting")


def next_pairs(post: DataFrame, tested: DataFrame) -> DataFrame:
    """(u, v): each class of open postings with the `to` of another label that it meets most often; of_u and of_v are their labels."""
    met = post.where((F.col("label") != F.col("to.label")) & fitting("length", "to.length"))
    met = met.groupBy("key_a", F.col("to.key_a").alias("v")).agg(F.count("*").alias("n"), F.first("label").alias("of_u"), F.first("to.label").alias("of_v"))
    return most_met(untested(met, "key_a", tested), "of_u", "of_v")


def hooked(labels: DataFrame, told: DataFrame) -> DataFrame:
    """The labels where those that a link ties to lesser ones give way to the least of these."""
    hooks = told.where("alike").groupBy(F.col("of_u").alias("label")).agg(F.min("of_v").alias("least"))
    moved = labels.join(hooks, "label", "left").select("node", F.coalesce("least", "label").alias("label"))
    return shortened(moved.union(hooks.select(F.col("label").alias("node"), F.col("least").alias("label"))).groupBy("node").agg(F.min("label").alias("label")))


def untested(pairs: DataFrame, u: str, tested: DataFrame) -> DataFrame:
    """The pairs (u, v) that were not compared yet, in either order."""
    both = tested.select("u", "v").union(tested.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return pairs.join(both.select(F.col("u").alias(u), "v"), [u, "v"], "left_anti")


def open_pairs(post: DataFrame, labels: DataFrame) -> DataFrame:
    """(u, v): classes of different components that share a posting, as far as their lengths allow a link.

    A large posting is cut into blocks that meet each other; those of its pivot's component don't meet among themselves.
    """
    named = labelled(post.drop("label", "to"), labels)
    groups = named.groupBy("posting").agg(F.min("label").alias("one"), F.max("label").alias("other"), F.max(F.when(F.col("key_a") == F.col("pivot"), F.col("label"))).alias("home")).where("one <> other").select("posting", "home")
    placed = named.join(groups, "posting").withColumn("own", (F.col("label") == F.col("home")) & (F.col("size") > MET))
    blocks = F.ceil(F.col("size") / MET).cast("int")
    block = F.when(F.col("size") <= MET, 0).otherwise(F.pmod(F.xxhash64("key_a", "posting"), blocks) + F.when(F.col("own"), blocks).otherwise(0)).cast("int")
    last = F.when(F.col("size") <= MET, 0).when(F.col("own"), blocks - 1).otherwise(2 * blocks - 1)
    met = placed.withColumn("block", block).withColumn("meets", F.explode(F.sequence(F.lit(0), last)))
    met = met.select("posting", F.least("block", "meets").alias("low"), F.greatest("block", "meets").alias("high"), "block", "key_a", "label", "length")
    x, y = met.alias("x"), met.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("posting", "low", "high")]
    apart = (F.col("x.block") != F.col("y.block")) | (F.col("x.low") == F.col("x.high"))
    pairs = x.join(y, reduce(lambda p, q: p & q, [*same, F.col("x.label") < F.col("y.label"), apart, fitting("x.length", "y.length")]))
    return pairs.select(F.greatest("x.key_a", "y.key_a").alias("u"), F.least("x.key_a", "y.key_a").alias("v")).distinct()


def shared_lines(found: DataFrame, classes: DataFrame, post: DataFrame) -> DataFrame:
    """key_a and line of the classes that share postings, looked up at their first occurrences.

    Classes are what is hashed, so that lines are not sorted, and a very common one can be split: what follows is dealt by key_a alone.
    """
    at = classes.select("first", *CLASS).join(post.select("key_a").distinct().hint("shuffle_hash"), "key_a")
    return found.join(at.hint("shuffle_hash"), CLASS).where(F.struct("doc_id", "text_key", "place").eqNullSafe(F.col("first"))).groupBy("key_a").agg(F.first("line").alias("line"))


def linked(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs, told whether their normalised lines have the edit similarity. What many share is met first, so that pairs end dealt by u."""
    u, v = lines.select(F.col("key_a").alias("u"), F.col("line").alias("a")), lines.select(F.col("key_a").alias("v"), F.col("line").alias("b"))
    return written(pairs.join(v, "v").join(u, "u").select(*pairs.columns, alike("a", "b").alias("alike")), "links")


def alike(a: str, b: str) -> Column:
    """Whether the edit distance of two lines, of words with one space between, is at most that of SIMILAR.

    Words that they begin and end with alike don't count. What remains is near enough if it is short, or if its words that
    differ, place by place, are; else its distance tells.
    """
    most = F.floor(F.greatest(F.length(a), F.length(b)) * (1 - SIMILAR) + 1e-9).cast("int")
    differ = lambda x, y: F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q))
    equal = lambda x, y: F.greatest(F.array_position(differ(x, y), F.lit(True)) - 1, F.lit(0)).cast("int")

    def cut(w: Column) -> Column:
        n = F.least(F.size(w["x"]), F.size(w["y"]))
        return let(F.struct(w["x"].alias("x"), w["y"].alias("y"), equal(w["x"], w["y"]).alias("head"), equal(F.reverse(w["x"]), F.reverse(w["y"])).alias("tail"), n.alias("n")), middles)

    def middles(w: Column) -> Column:
        tail = F.least(w["tail"], w["n"] - w["head"])
        part = lambda x: F.slice(x, w["head"] + 1, F.size(x) - w["head"] - tail)
        return let(F.struct(part(w["x"]).alias("x"), part(w["y"]).alias("y")), compared)

    def compared(w: Column) -> Column:
        # every word with a space behind it, so that a part without words is empty
        text = lambda x: F.when(F.size(x) > 0, F.concat(F.array_join(x, " "), F.lit(" "))).otherwise("")
        changed = F.aggregate(F.zip_with(w["x"], w["y"], lambda p, q: F.when(p.eqNullSafe(q), 0).otherwise(F.greatest(F.length(p), F.length(q)) + (p.isNull() | q.isNull()).cast("int"))), F.lit(0), lambda s, n: s + n)
        return let(F.struct(text(w["x"]).alias("a"), text(w["y"]).alias("b"), most.alias("most")), lambda t: F.when(F.greatest(F.length(t["a"]), F.length(t["b"])) <= t["most"], True).when(changed <= t["most"], True).otherwise(banded(t["a"], t["b"], t["most"])))

    return let(F.struct(F.split(a, " ").alias("x"), F.split(b, " ").alias("y")), cut)


def banded(a: Column, b: Column, most: Column) -> Column:
    """Edit distance of a and b at most `most`; bands far narrower than that, which tell near lines cheaply, come first."""
    within = lambda most: F.call_function("levenshtein", a, b, most) >= 0
    found = within(most)
    for band in (16384, 4096, 1024, 256, 64, 16):
        found = F.when(most <= 4 * band, within(most)).when(within(F.lit(band)), True).otherwise(found)
    return found


def groups(found: DataFrame, classes: DataFrame) -> DataFrame:
    """node and component of classes that are linked with others.

    Rounds of pivots end when one links few; the last comparison takes all that is apart then, however much it is. Labels of the
    rounds are classes of one's own component, but not always its least: what they leave apart is compared once more.
    """
    post = written(posted(classes), "postings")
    lines = written(shared_lines(found, classes, post), "lines")
    pairs = written(pivot_pairs(post), "pairs")
    tested = linked(lines, pairs)
    tables, most = [lines, pairs, tested], tested.where("alike").count()
    # a class has one pivot, less than itself, so that links are steps towards labels
    labels = written(shortened(shortened(tested.where("alike").select(F.col("u").alias("node"), F.col("v").alias("label")))), "labels")
    for _ in range(ROUNDS):
        last, post = post, written(still_open(post, labels), "postings")
        dropped(last)
        pairs = written(next_pairs(post, tested), "pairs")
        told = linked(lines, pairs)
        near = told.where("alike").count()
        last, labels = labels, written(hooked(labels, told), "labels")
        dropped(last)
        tested = tested.union(told.select("u", "v", "alike"))
        tables += [pairs, told]
        if FEW * near <= most:
            break
    rest = written(untested(open_pairs(post, labels), "u", tested), "pairs")
    more = linked(lines, rest)
    last = components(tested.union(more).where("alike"))
    dropped(*tables, post, labels, rest, more)
    return last


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and the places of the lines that go.

    Sides with a row a class are hashed, so that lines and classes are not sorted.
    """
    with swept(docs.sparkSession):
        found = written(occurrences(docs), "occurrences")
        classes = written(line_classes(found), "classes")
        joined = groups(found, classes)
        hashed = joined.hint("shuffle_hash")
        several = classes.select(*CLASS, "first").join(hashed, classes["key_a"] == joined["node"])
        firsts = several.groupBy("component").agg(F.min("first").alias("kept"))
        grouped = several.join(firsts, "component").select("key_a", "key_b", "kept")
        alone = classes.where("n > 1").join(hashed, classes["key_a"] == joined["node"], "left_anti").select("key_a", "key_b", F.col("first").alias("kept"))
        kept = grouped.union(alone).hint("shuffle_hash")
        gone = found.select("doc_id", "text_key", "place", *CLASS).join(kept, ["key_a", "key_b"]).where(~F.struct("doc_id", "text_key", "place").eqNullSafe(F.col("kept")))
        places = written(gone.groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("places")), "places")
        dropped(found, classes, joined)
    return places


def cut_rows(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), text (cut), n_lines and n_removed of every row; `emptied` tells that no line but blanks is left."""
    gone = removals(docs)
    keyed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), F.xxhash64(docs["text"]).alias("key"))
    both = keyed.join(gone.select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"), "places"), (F.col("key") == F.col("gone_key")) & F.col("doc_id").eqNullSafe(F.col("gone_id")), "left")
    rest = lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("places")), lambda k: F.get(x, k)), "\n")
    text = F.when(F.col("places").isNull(), F.col("text")).otherwise(let(F.split("text", "\n"), rest))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    told = both.select("row", text.alias("text"), n.cast("long").alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_removed"))
    return told.withColumn("emptied", (F.col("n_removed") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(r"\S"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text (cut), n_lines, n_removed and emptied of every row."""
    return cut_rows(docs).select(F.col("row.doc_id").alias("doc_id"), "text", "n_lines", "n_removed", "emptied")


def kept_rows(docs: DataFrame) -> DataFrame:
    """The rows with their texts cut and n_chars, if there is one, told anew; rows of which no line is left go."""
    made = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row")["n_chars"]) if "n_chars" in docs.columns else None}
    return cut_rows(docs).where("not emptied").select(*(made[c].alias(c) if c in made else F.col("row")[c].alias(c) for c in docs.columns))
