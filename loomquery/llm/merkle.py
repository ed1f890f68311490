"""Document fingerprints: a Merkle tree over paragraphs and sections, in DataFrame functions only.

A text's sections end at blank lines. A section's paragraphs end at line ends
and, within a line, at borders that its content sets: white space after a few
letters, some marks, and common characters of scripts without spaces. So what
is put in or taken out moves no border but those beside it. Only where none
comes for MOST code points is a paragraph cut by length.

A paragraph's node hashes its text, a section's node its paragraphs' hashes
and the root its sections', all by SHA-256: roots test equality, and branches
that differ locate edits. A fingerprint writes the tree as a string,
``root|section:paragraphs;section:paragraphs``, with hashes below the root
shortened to SHORT digits. Fingerprints are likened by their trees: by the
paragraphs, branches that are equal with all of theirs, that both hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of a hash below the root, code points of a paragraph without a border, and bytes of text that a task takes.
SHORT, MOST, PART_BYTES = 6, 256, 32 << 20

# Letters after which white space is a border (one or two of ten
# words of western European languages end in one), marks after which it is one,
# and common characters of Chinese, Japanese and Thai after which there is one.
LETTERS, MARKS, COMMON = "ltLT", ".,;:!?", "。，、的了是在のはをにรนก"
BORDER = rf"(?<=\n)(?!\n)|(?<=[{LETTERS}{MARKS}]\x20)(?!\x20)|(?<=[{COMMON}])"


def tree(text: Column) -> Column:
    """The nodes below the root of a text that isn't null: an array of sections, each with its own hash and its paragraphs'."""
    def paragraphs(section):
        parts = F.filter(F.split(section, BORDER, -1), lambda p: p != "")
        long = lambda p: F.when(F.char_length(p) > MOST, F.regexp_extract_all(p, F.lit(r"(?s).{1,%d}" % MOST), F.lit(0))).otherwise(F.array(p))
        return F.transform(F.flatten(F.transform(parts, long)), lambda p: F.sha2(p, 256))

    sections = F.filter(F.split(text, r"(?<=\n\n)(?=[^\n])", -1), lambda s: s != "")
    return F.transform(F.transform(sections, paragraphs), lambda p: F.struct(F.sha2(F.array_join(p, ""), 256).alias("own"), p.alias("paragraphs")))


def fingerprint(text: Column) -> Column:
    """The string form of a text's tree; a null text is empty."""
    def written(sections):
        root = F.sha2(F.array_join(F.transform(sections, lambda s: s["own"]), ""), 256)
        short = F.transform(sections, lambda s: F.concat(F.substring(s["own"], 1, SHORT), F.lit(":"), F.array_join(F.transform(s["paragraphs"], lambda p: F.substring(p, 1, SHORT)), "")))
        return F.concat_ws("|", root, F.array_join(short, ";"))

    return F.transform(F.array(tree(F.coalesce(text, F.lit("")))), written)[0]


def sections(print_: Column) -> Column:
    """The sections of a fingerprint: (own, paragraphs), as short hashes."""
    parts = F.filter(F.split(F.split(print_, r"\|")[1], ";"), lambda s: s != "")
    return F.transform(parts, lambda s: F.struct(F.substring(s, 1, SHORT).alias("own"), F.regexp_extract_all(F.substring(s, SHORT + 2, F.char_length(s)), F.lit("[0-9a-f]{%d}" % SHORT), F.lit(0)).alias("paragraphs")))


def leaves(print_: Column) -> Column:
    """The different paragraphs of a fingerprint, as short hashes."""
    return F.array_distinct(F.flatten(F.transform(sections(print_), lambda s: s["paragraphs"])))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two trees by their different paragraphs, 0 to 1: those that both hold, of those of the one that holds more; 1 if neither has any."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / most)


def edits(a: Column, b: Column) -> Column:
    """(section, paragraph), from 0, of the paragraphs in the first fingerprint's tree that differ from the second's.

    Sections that the second tree holds too aren't entered; in others, the
    paragraphs differ that none of the second's own differing sections holds.
    What only the second tree has is found the other way round.
    """
    def differing(own, other):
        gone = F.transform(other, lambda s: s["own"])
        return F.transform(own, lambda s, i: F.struct(i.cast("int").alias("section"), F.when(F.array_contains(gone, s["own"]), F.array().cast("array<string>")).otherwise(s["paragraphs"]).alias("paragraphs")))

    def located(pair):
        mine, theirs = differing(pair["a"], pair["b"]), F.flatten(F.transform(differing(pair["b"], pair["a"]), lambda s: s["paragraphs"]))
        return F.transform(F.array(F.struct(mine.alias("mine"), theirs.alias("theirs"))), found)[0]

    def found(both):
        marked = F.transform(both["mine"], lambda s: F.transform(s["paragraphs"], lambda p, i: F.struct(s["section"].alias("section"), i.cast("int").alias("paragraph"), F.array_contains(both["theirs"], p).alias("same"))))
        return F.transform(F.filter(F.flatten(marked), lambda p: ~p["same"]), lambda p: F.struct(p["section"].alias("section"), p["paragraph"].alias("paragraph")))

    return F.transform(F.array(F.struct(sections(a).alias("a"), sections(b).alias("b"))), located)[0]


def with_next(df: DataFrame, id_col: str, text_col: str, parts: int | None = None) -> DataFrame:
    """(id, text, print, following, next_print): each row with text and fingerprint of the next one by id and then by the text's SHA-256, of the last with the first's; nulls come first.

    Rows are dealt by ranges of their order, as many as their bytes ask for.
    Bounds come from dealing the ids alone; ids of any type that can be
    ordered will do, however they are spread and however often one repeats.
    The last row of a range looks at the first of the next one that has any.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if parts is None:
        parts = -(-(rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // PART_BYTES)
        parts = max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("at", F.struct("id", F.sha2("text", 256).alias("digest"), F.monotonically_increasing_id().alias("row")))
    least = rows.select("at").repartitionByRange(max(1, parts), "at").groupBy(F.spark_partition_id()).agg(F.min("at").alias("at"))
    bounds = least.agg(F.array_sort(F.collect_list("at")).alias("bounds")).scalar()  # a row a range
    steps = F.array(*[F.lit(1 << k) for k in range(max(1, parts).bit_length(), -1, -1)])
    # the last bound up to the row, by halving
    range_ = F.aggregate(steps, F.lit(0), lambda a, s: F.when(F.get(F.col("bounds"), a + s) <= F.col("at"), a + s).otherwise(a))
    rows = rows.withColumn("bounds", bounds).withColumn("range", range_).drop("bounds")
    # fingerprints are made where rows have met, so they don't travel
    met = rows.repartition("range").withColumn("print", fingerprint(F.col("text")))
    led = met.withColumn("next", F.lead(F.struct("text", "print")).over(Window.partitionBy("range").orderBy("at")))
    heads = rows.groupBy("range").agg(F.min_by("text", "at").alias("text")).withColumn("head", F.struct("text", fingerprint(F.col("text")).alias("print")))
    ring = Window.orderBy("range")  # a row a range
    heads = heads.withColumn("wrapped", F.coalesce(F.lead("head").over(ring), F.first("head").over(ring))).select("range", "wrapped")
    out = led.join(heads, "range").withColumn("next", F.coalesce("next", "wrapped"))
    return out.select("id", "text", "print", F.col("next.text").alias("following"), F.col("next.print").alias("next_print"))


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edit, which ends in the beginning of the next text instead of its own last quarter.

    Returns the id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. A null text is empty; equal texts have equal
    fingerprints; the next of rows with one id is by the text's SHA-256; a
    single row is its own next; an empty table gives an empty result.
    """
    rows = with_next(df, id_col, text_col, parts)
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("moved", F.floor(F.col("n_chars") / 4).cast("int"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("moved")).cast("int")), F.substring(F.col("following"), F.lit(1), F.col("moved")))
    rows = rows.withColumn("edited", edited).withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    rows = rows.withColumns({"own": leaves(F.col("print")), "near_edited": leaves(F.col("edited_fingerprint")), "near_next": leaves(F.col("next_print"))})
    return rows.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("print").alias("fingerprint"), "edited_fingerprint",
        likeness(F.col("own"), F.col("near_edited")).alias("near_edited"), likeness(F.col("own"), F.col("near_next")).alias("near_next"),
    )
