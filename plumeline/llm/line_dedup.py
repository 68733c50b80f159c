"""Fuzzy dedup of lines: one line of each component stays.  DataFrame and SQL functions only.

Signatures.  A line's shingles are its pieces of SHINGLE bytes of UTF-8 at all positions; short lines use pieces of GRAM
bytes, those of OVERLAP bytes both (in other scripts than Latin pieces hold fewer characters, so an edit touches fewer of
them, and lines that are alike agree by more).  Positions are exploded and hashed in generated code, hashes above a bound
(CHOSEN are expected below it) go at once, and the smallest hash of each of BINS bins (one-permutation MinHash) is kept.  A
line that repeats itself may leave few bins filled; it is done again without the bound, and if its pieces are few, with both
widths.
Bands.  Two filled bins that follow each other make a band key.  Lines that share a key are candidates, unless their
signatures have less than AGREE of their values in common.
Sketches.  A line that may have a partner gets the parities of its pieces of GRAM characters in 64 * WORDS bits.  Sketches
differ in no more bits than the sets have members in one alone, so what they rule out is ruled out exactly.
Verification.  The exact Jaccard similarity of the two sets of pieces of GRAM characters, counted per pair that sketches leave.
Union-find over the verified pairs, distributed, gives the components.
Buckets.  Each member of a bucket is compared with its NEAR successors in the bucket's order (of chunks of about CHUNK lines)
and with the first, which is all pairs of a small bucket: each line's likeliest partner first, then those that this left in
another component.  In larger buckets all members that are in different components by then are compared, in blocks of about
BLOCK lines: first by the codes of their signatures, which tell the members that have a candidate there, then those by their
sketches, and verified.  Pairs inside a component would change nothing.

Two lines of similarity 0.8 whose sets of shingles agree by 0.67 (scattered edits touch more shingles than grams) are no
candidates with a probability of about 0.008, at 0.75 of 0.0016, at 0.82 of 0.0002 (simulated, 300 shingles of characters).  Lines are known by a 64-bit hash: among
10**10 different lines two share one with a probability of 3 %, and would count as equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, documents, drop_cut, fresh
from .components import components

#: LEAST: lines of fewer characters are too short to judge, and always stay.
SHINGLE, GRAM, LEAST, NEAR, BLOCK, CHUNK = 9, 5, 5, 4, 512, 4096
#: Bins, hashes expected below the bound, filled bins below which a line is done again, bytes of short lines that have
#: both signatures, share of all values of two candidates that they have in common.
BINS, CHOSEN, FEW, OVERLAP, AGREE = 14, 32, 7, (40, 60), 0.2
#: Different grams from which on a line that repeats itself has no signature of grams.
MANY = 120
#: Candidate lines that may be broadcast (8 bytes each) to fetch their texts; more are joined by a shuffle.
BROADCAST_LINES = 1_000_000
THRESHOLD = 0.8
VALUE_BITS = 27
#: Sketches of grams have 64 * WORDS bits.
WORDS = 16


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), pos (from 0) and line of every line; h: the line's hash.  A line ends with \\n."""
    d = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return d.where(F.length("line") >= LEAST).withColumn("h", F.xxhash64("line"))


def _piece(b: str, at: str, width: int) -> str:
    return f"substring({b}, {at} + 1, {width})"


def _signed(found: DataFrame, whole: bool = False) -> DataFrame:
    """From h, line: h, kind (0: shingles, 1: grams), n, sig, the smallest hash of each filled bin as 16 * hash + bin, and c0 and
    c1, the codes of the even and the odd bins, a byte each: 0 if it is empty, else 1 + hash % 255.  whole: without the bound, and with both kinds for every line."""
    grams_from, shingles_from = ("true", "true") if whole else (f"n <= {OVERLAP[1]}", f"n >= {OVERLAP[0]}")
    last = lambda width: f"greatest(n - {width}, 0)"
    places = f"sequence(if({grams_from}, -{last(GRAM)} - 1, 0), if({shingles_from}, {last(SHINGLE)}, -1))"
    at = found.select("h", F.expr("cast(line as binary)").alias("b"), F.octet_length("line").alias("n")).select("h", "n", "b", F.expr(f"explode({places})").alias("i"))
    at = at.select("h", "n", (F.col("i") < 0).cast("int").alias("kind"), "i", F.expr(f"xxhash64(if(i < 0, {_piece('b', '-i - 1', GRAM)}, {_piece('b', 'i', SHINGLE)}))").alias("x"))
    value = f"(x & {(1 << VALUE_BITS) - 1}L)"
    below = F.lit(True) if whole else F.expr(f"n <= {CHOSEN} or {value} * n < {CHOSEN << VALUE_BITS}L")
    at = at.withColumn("below", below).where("below or i = 0 or i = -1")  # a line without any stays in the table
    at = at.select("h", "kind", "n", F.expr(f"if(below, cast(shiftrightunsigned(x, 33) % {BINS} as int), -1)").alias("bin"), F.expr(f"cast({value} as int)").alias("v"))
    least = [F.min(F.when(F.col("bin") == k, F.col("v"))).alias(f"v{k}") for k in range(BINS)]
    tagged = F.array_remove(F.array(*[F.expr(f"coalesce(v{k} * 16 + {k}, -1)") for k in range(BINS)]), -1)  # in generated code
    codes = [F.expr(" + ".join(f"coalesce(shiftleft(1L + v{k} % 255, {8 * (k // 2)}), 0L)" for k in range(odd, BINS, 2))).alias(f"c{odd}") for odd in (0, 1)]
    return at.groupBy("h", "kind", "n").agg(*least).select("h", "kind", "n", tagged.alias("sig"), *codes)


def signatures(docs: DataFrame, places: DataFrame) -> DataFrame:
    """h, kind, n, sig, c0, c1 of the different lines of docs, written to the shared folder.  places (h, at): one place of each line."""
    found = lines(docs).select("h", "line")
    first = cut(_signed(found), "line-signatures")
    few = cut(first.where((F.size("sig") < FEW) & (F.col("n") > CHOSEN)).select("h").distinct(), "line-repetitive")
    # grams serve lines of few different ones, which may be a short line's; smallest hashes that lie low tell of many
    mean = F.aggregate("sig", F.lit(0).cast("long"), lambda total, x: total + F.shiftright(x, 4)) / F.size("sig")
    held = places.join(_small(few), "h", "left_semi").select("at.th").distinct()
    again = docs.select("doc_id", "text").join(_small(held), F.xxhash64("text") == F.col("th"), "left_semi")
    again = lines(again).select("h", "line")
    again = _signed(_texts(again, few), whole=True).where((F.col("kind") == 0) | (mean * MANY >= BINS << VALUE_BITS))
    again = cut(again, "line-signatures-again")
    return first.join(_small(few), "h", "left_anti").unionByName(again)


def _small(some: DataFrame) -> DataFrame:
    """some (of one long a row), marked for broadcast if it is small enough for that."""
    return F.broadcast(some) if some.count() <= BROADCAST_LINES else some


def _texts(found: DataFrame, some: DataFrame) -> DataFrame:
    """h, line of the lines that some (h) names."""
    return found.join(_small(some), "h", "left_semi").groupBy("h").agg(F.first("line").alias("line"))


def band_keys(signed: DataFrame) -> DataFrame:
    """h, key: a key for each filled bin and the next one; a line with one filled bin has one key of it.  The key's lowest bit
    is the signature's kind.  Keys have 48 bits, since their shuffle is the largest; two that clash are one bucket, in which
    nothing is left out."""
    keys = [F.when(F.size("sig") > k, F.xxhash64("kind", F.get("sig", F.lit(k - 1)), F.get("sig", F.lit(k)))) for k in range(1, BINS)]
    alone = F.when(F.size("sig") == 1, F.xxhash64("kind", F.get("sig", F.lit(0))))
    each = signed.select("h", "kind", F.explode(F.array(*keys, alone)).alias("key")).where("key is not null")
    return each.select("h", F.expr("(shiftrightunsigned(key, 16) & -2L) | kind").alias("key"))


def _agree(a: str, b: str) -> Column:
    """Whether two signatures (prefixes of the columns of their codes) may have enough of their values in common: equal values
    have equal codes, so none that have is lost."""
    low, high = (int(x * 7, 16) for x in ("7f", "80"))  # a sum's top bit tells a byte that is not 0
    filled = lambda x: f"bit_count(((({x}) & {low}L) + {low}L | ({x})) & {high}L)"
    # bins that one of the two fills, without those where they differ
    common = " + ".join(f"{filled(f'{a}c{k} | {b}c{k}')} - {filled(f'{a}c{k} ^ {b}c{k}')}" for k in (0, 1))
    both = " + ".join(filled(f"{x}c{k}") for x in (a, b) for k in (0, 1))
    return F.expr(f"({common}) * {1 + AGREE}D >= {AGREE}D * ({both}) - 1e-9D")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def first_places(docs: DataFrame) -> DataFrame:
    """h, at: each different line's first place (doc_id, hash of the text, position), written to the shared folder."""
    return cut(lines(docs).groupBy("h").agg(F.min(F.struct("doc_id", "th", "pos")).alias("at")), "line-first")


def verified_pairs(docs: DataFrame, threshold: float = THRESHOLD, places: DataFrame | None = None) -> DataFrame:
    """u, v: hashes of two different lines of docs that links of at least the threshold connect; of pairs that share a band,
    enough to connect all that are linked.  places: first_places(docs), if the caller has them."""
    signed = signatures(docs, first_places(docs) if places is None else places)
    size = F.count("*").over(Window.partitionBy("key"))
    members = cut(band_keys(signed).withColumn("size", size).where("size > 1").withColumn("kind", F.expr("cast(key & 1 as int)")), "line-members")
    shared = cut(members.join(signed.select("h", "kind", "c0", "c1"), ["h", "kind"]), "line-shared")
    drop_cut(members, signed)

    # a large bucket's order is laid out in chunks, so that no task sorts all of it
    order = Window.partitionBy("key", F.pmod(F.xxhash64("h"), F.ceil(F.col("size") / CHUNK))).orderBy(F.xxhash64("h", "key"))
    mine = F.struct("h", "c0", "c1")
    partners = [F.lead(mine, k).over(order) for k in range(1, NEAR + 1)]
    near = shared.select("h", "c0", "c1", F.array(*partners, F.first(mine).over(order)).alias("o")).select("h", "c0", "c1", F.explode("o").alias("o")).where("h <> o.h")
    near = near.where(_agree("", "o.")).select("h", F.col("o.h").alias("g"))
    near = cut(near.select(*_ordered("h", "g")).distinct(), "line-near")

    wanted = cut(near.select(F.explode(F.array("u", "v")).alias("h")).distinct(), "line-wanted")
    texts = cut(_texts(lines(docs).select("h", "line"), wanted), "line-texts")
    sketches = cut(_sketched(texts), "line-sketches")
    possible = cut(_possible(near, sketches, threshold), "line-possible")
    drop_cut(near)

    # each line's likeliest partner first; of what that left in different components the likeliest pair of each two; then the
    # pairs that are in different components still
    each = possible.select(F.explode(F.array("u", "v")).alias("h"), F.struct("unlike", "u", "v", "m", "n").alias("pair"))
    best = cut(each.groupBy("h").agg(F.min("pair").alias("pair")).select("pair.*").distinct(), "line-best")
    group = components(cut(_close(best, texts, threshold), "line-close"), "line-close-components")
    rest = cut(_across(possible.join(best, ["u", "v"], "left_anti"), group), "line-rest")
    first = cut(rest.groupBy("r", "s").agg(F.min(F.struct("unlike", "u", "v", "m", "n")).alias("pair")).select("pair.*"), "line-rest-first")
    more = cut(_close(first, texts, threshold), "line-rest-first-close")
    group = components(_edges(group).unionByName(more), "line-rest-components")
    left = cut(_across(rest.drop("r", "s").join(first, ["u", "v"], "left_anti"), group), "line-rest-left")
    more = cut(_close(left, texts, threshold), "line-rest-close")
    drop_cut(best, rest, first, left)
    group = components(_edges(group).unionByName(more), "line-near-components")
    large = cut(_large(shared, group), "line-large")
    drop_cut(shared)
    agreeing = cut(_agreeing(large), "line-agreeing")
    added = cut(agreeing.join(wanted, "h", "left_anti"), "line-added")
    texts = texts.unionByName(cut(_texts(lines(docs).select("h", "line"), added), "line-texts-added"))
    sketches = sketches.unionByName(cut(_sketched(texts.join(_small(added), "h", "left_semi")), "line-sketches-added"))
    large = cut(_mixed(large.join(_small(agreeing), "h", "left_semi")), "line-mixed")
    far = cut(_apart(large, sketches, threshold).join(possible, ["u", "v"], "left_anti"), "line-far")
    drop_cut(wanted, agreeing, added, possible, sketches)
    more = cut(_close(far, texts, threshold), "line-far-close")
    drop_cut(far, texts)
    return _edges(group).unionByName(more)


def _edges(group: DataFrame) -> DataFrame:
    return group.select(F.col("node").alias("u"), F.col("root").alias("v"))


def _sketched(texts: DataFrame) -> DataFrame:
    """h, n and s0, s1, ...: the number of a line's different grams and its sketch, of 64 * WORDS bits: each is the parity of
    the grams that fall on it.  Two sketches differ in no more bits than the sets have members that only one of them has."""
    at = texts.select("h", grams(F.col("line")).alias("g"))
    at = at.select("h", F.explode_outer("g").alias("x"))  # in generated code; explode() would have g worked out twice, to see if it is empty
    at = at.select("h", F.expr(f"cast(shiftrightunsigned(x, 6) % {WORDS} as int)").alias("k"), F.expr("shiftleft(1L, cast(x & 63 as int))").alias("bit"))
    words = [F.coalesce(F.bit_xor(F.when(F.col("k") == k, F.col("bit"))), F.lit(0).cast("long")).alias(f"s{k}") for k in range(WORDS)]
    return at.groupBy("h").agg(F.count("*").cast("int").alias("n"), *words)


def _side(h: str, n: str, s: str) -> list[Column]:
    """The columns of a table of sketches under other names."""
    return [F.col("h").alias(h), F.col("n").alias(n), *[F.col(f"s{k}").alias(f"{s}{k}") for k in range(WORDS)]]


def _unlike(a: str, b: str) -> Column:
    """Bits in which two sketches differ."""
    return F.expr(" + ".join(f"bit_count({a}{k} ^ {b}{k})" for k in range(WORDS)))


def _reachable(m: str, n: str, unlike: Column, threshold: float) -> Column:
    """Whether sets of m and n members, of which at least `unlike` are in one alone, can reach the threshold; proved if not."""
    t = F.lit(threshold)
    return (F.least(m, n) >= t * F.greatest(m, n) - F.lit(1e-9)) & (unlike * (1 + t) <= (1 - t) * (F.col(m) + F.col(n)) + F.lit(1e-6))


def _possible(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """u, v, m, n, unlike of the pairs that their sketches leave: m, n: numbers of grams; unlike: bits that differ, by m + n."""
    both = pairs.join(sketches.select(*_side("u", "m", "p")), "u").join(sketches.select(*_side("v", "n", "q")), "v")
    both = both.where(_reachable("m", "n", _unlike("p", "q"), threshold))
    return both.select("u", "v", "m", "n", (_unlike("p", "q") / (F.col("m") + F.col("n"))).alias("unlike"))


def _across(pairs: DataFrame, group: DataFrame) -> DataFrame:
    """The pairs that are in different components of group, r and s (r < s)."""
    of = lambda h, r: group.select(F.col("node").alias(h), F.col("root").alias(r))
    return pairs.join(of("u", "r"), "u", "left").join(of("v", "s"), "v", "left").withColumns({"r": F.coalesce("r", "u"), "s": F.coalesce("s", "v")}).where("r <> s").withColumns({"r": F.least("r", "s"), "s": F.greatest("r", "s")})


def _large(shared: DataFrame, group: DataFrame) -> DataFrame:
    """h, key, root, size, c0, c1: members of the buckets with more lines than the near ones of each, if group has different
    components of them."""
    large = shared.where(F.col("size") > NEAR + 1).join(group.withColumnRenamed("node", "h"), "h", "left")
    return _mixed(cut(large.withColumn("root", F.coalesce("root", "h")), "line-large-all"))


def _mixed(large: DataFrame) -> DataFrame:
    """Members of buckets that hold lines of different components, with the bucket's size."""
    mixed = large.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("lowest"), F.max("root").alias("highest"))
    return large.drop("size").join(mixed.where("lowest <> highest").select("key", "size"), "key")


def _dealt(large: DataFrame) -> DataFrame:
    """large with x, the block of a bucket in which a line is, among about size / BLOCK."""
    return large.withColumn("chunks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("x", F.pmod(F.xxhash64("h"), F.col("chunks")).cast("int"))


def _agreeing(large: DataFrame) -> DataFrame:
    """h of the lines that a candidate of another component shares a large bucket with.  Each line is sought in each block, and a
    row tells that it was met there, so the rows do not grow with the pairs."""
    dealt = _dealt(large)
    here = dealt.select("h", F.col("root").alias("r"), F.col("key").alias("k"), F.explode(F.expr("sequence(0, chunks - 1)")).alias("y"), F.col("c0").alias("pc0"), F.col("c1").alias("pc1"))
    there = dealt.select("key", "x", F.col("root").alias("s"), F.col("c0").alias("qc0"), F.col("c1").alias("qc1"))
    return here.join(there, F.expr("k = key and y = x and r <> s") & _agree("p", "q"), "left_semi").select("h").distinct()


def _apart(large: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """u, v, m, n: pairs of a large bucket that are in different components and that their sketches leave."""
    dealt = _dealt(large.join(sketches, "h")).withColumn("y", F.explode(F.expr("sequence(0, chunks - 1)")))
    dealt = dealt.withColumns({"bi": F.least("x", "y"), "bj": F.greatest("x", "y")})
    half = lambda at, h, root, n, s: dealt.where(f"x = {at}").select("key", "bi", "bj", F.col("root").alias(root), *_side(h, n, s))
    both = half("bi", "a", "r", "m", "p").join(half("bj", "b", "s", "n", "q"), ["key", "bi", "bj"])
    both = both.where("r <> s and (bi < bj or a < b)").where(_reachable("m", "n", _unlike("p", "q"), threshold))
    sized = F.when(F.col("a") < F.col("b"), F.struct(F.col("a").alias("u"), F.col("b").alias("v"), "m", "n")).otherwise(F.struct(F.col("b").alias("u"), F.col("a").alias("v"), F.col("n").alias("m"), F.col("m").alias("n")))
    return both.select(sized.alias("pair")).select("pair.*").distinct()


def grams(line: Column) -> Column:
    """The set of a line's pieces of GRAM characters at all positions, as 64-bit hashes; of a shorter line, the whole line."""
    return F.array_distinct(_every_gram(line))


def _every_gram(line: Column) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(F.length(line) - GRAM, F.lit(0)))
    return _once(F.encode(line, "UTF-32"), lambda b: F.transform(starts, lambda i: F.xxhash64(F.substring(b, 4 * i + 1, F.lit(4 * GRAM)))))


def _once(value: Column, use) -> Column:
    """use(value), with value worked out a single time however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _close(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """u, v of the pairs (a written table with m, n, the numbers of grams) whose exact similarity reaches the threshold."""
    texts = texts.join(_small(pairs.select(F.explode(F.array("u", "v")).alias("h")).distinct()), "h", "left_semi")
    side = lambda h, line: texts.select(F.col("h").alias(h), F.col("line").alias(line))
    both = pairs.select("u", "v", "m", "n").join(side("u", "a"), "u").join(side("v", "b"), "v")
    same = F.size(F.array_intersect(_every_gram(F.col("a")), _every_gram(F.col("b"))))  # different ones, of m + n - same in all
    return both.where(same * (1 + threshold) >= F.lit(threshold) * (F.col("m") + F.col("n")) - F.lit(1e-9)).select("u", "v")


def kept_positions(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, th, kept: for each text (by doc_id and hash) that keeps any line of LEAST characters or more, the positions of
    those.  Of a component the line that comes first stays: smallest doc_id (null first), then hash of the text, position."""
    first = first_places(docs)
    group = components(verified_pairs(docs, threshold, first), "line-components")
    tied = group.select(F.col("node").alias("h"), "root").union(group.select(F.col("root").alias("h"), "root").distinct())
    whole = first.join(_small(tied), "h", "left")
    stay = whole.where("root is not null").groupBy("root").agg(F.min("at").alias("at")).select("at.*")
    stay = whole.where("root is null").select("at.*").unionByName(stay)
    return stay.groupBy("doc_id", "th").agg(F.collect_list("pos").alias("kept"))


def decisions(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_lines, kept (positions of the lines that stay, ascending, from 0) of each row of docs.

    Lines shorter than LEAST characters, blank ones among them, always stay.  Null text has no lines, empty text one empty
    line.  Rows with the same doc_id and text are one document that was read twice: all get the same decisions.  An empty
    table gives an empty table."""
    sizes = F.transform(F.split("text", "\n"), F.length)  # null for null
    lean = docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce(sizes, F.array().cast("array<int>")).alias("sizes"))
    short = F.filter(F.transform("sizes", lambda n, i: F.when(n < LEAST, i)), lambda i: i.isNotNull())
    lean = lean.select("doc_id", "th", F.size("sizes").alias("n_lines"), short.alias("short"))
    kept = kept_positions(docs, threshold).withColumnRenamed("doc_id", "id").withColumnRenamed("th", "t")
    out = lean.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("t")), "left")
    every = F.array_sort(F.concat("short", F.coalesce("kept", F.array().cast("array<int>"))))
    return out.select("doc_id", "n_lines", every.alias("kept"))


def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the lines that stay (see decisions), in their order; a column n_chars follows the new text.  Documents of
    which no line with a sign other than white space is left go; those that had none stay as they are."""
    names = docs.columns
    of, t, kept, h, parts, places, new = fresh(docs, "of", "t", "kept", "h", "parts", "places", "new")
    found = kept_positions(docs, threshold).select(F.col("doc_id").alias(of), F.col("th").alias(t), F.col("kept").alias(kept))
    joined = docs.withColumn(h, F.xxhash64("text")).join(found, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(h) == F.col(t)), "left")
    joined = joined.withColumn(parts, F.split("text", "\n"))
    short = F.filter(F.transform(parts, lambda x, i: F.when(F.length(x) < LEAST, i)), lambda i: i.isNotNull())
    joined = joined.withColumn(places, F.array_sort(F.concat(short, F.coalesce(kept, F.array().cast("array<int>")))))
    joined = joined.withColumn(new, F.array_join(F.transform(places, lambda i: F.get(F.col(parts), i)), "\n"))
    blank = lambda c: F.coalesce(F.trim(F.regexp_replace(c, r"\s+", "")), F.lit("")) == ""
    joined = joined.where(~blank(F.col(new)) | blank(F.col("text")))
    changed = {"text": F.col(new)} | ({"n_chars": F.length(new).cast("long")} if "n_chars" in names else {})
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in names])


def query(spark, sf_dir: str) -> DataFrame:
    """The lines of all documents."""
    return decisions(documents(spark, sf_dir))
