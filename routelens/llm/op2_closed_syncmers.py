"""Document fingerprints from closed syncmers.

A text is a sequence of words (longer ones cut into pieces of 16 characters).  Of its runs of five words
those are anchors whose least inner run of two words, by hash, is the first or the last.  Whether a run
is an anchor depends on its own words alone, so an edit touches only the anchors around it.  The
fingerprint is all anchors, each with its place, ordered by hash.  A text of words without such a run, as
all of fewer than five words and some of five or six, has one anchor for the whole; a text without words
has none.

The likeness of two fingerprints is the share, among the anchors of both, of those that both have and that
match by place: another common anchor lies as far apart in the two texts, or there is no other.  Two texts
without anchors have likeness 1.

The next document is found on keys alone, by a range-partitioned sort; its text then travels whole, as all
its anchors are compared.  DataFrame functions only, and every array is as long as two texts at most.

Null text counts as empty.  Documents go by doc_id, null first, then by a hash of the text; rows that
repeat both are one document, and each of them gives a row.  A single document is followed by itself.
Empty tables give no rows; other columns are not read.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.llm.common import documents, ranked, text_or_empty
from routelens.plans.shared import materialize

RUN, INNER = 5, 2
PIECE = r"[^\x20\x09-\x0D]{1,16}"
PLACE_BITS = 23
_KEY = ["id_hash", "text_hash"]


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def _anchor(hashed: Column, place: Column | int) -> Column:
    place = F.lit(place) if isinstance(place, int) else place
    return F.struct(F.shiftrightunsigned(hashed, PLACE_BITS + 1).alias("hash"), place.cast("int").alias("place"))


def _anchors(words: Column) -> Column:
    """All anchors of a sequence of word hashes."""
    n = F.size(words)
    inner = F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1), lambda a, b: F.xxhash64(a, b))

    def of_runs(inner: Column) -> Column:
        def closed(i: Column) -> Column:
            between = F.least(*[inner[i + k] for k in range(1, RUN - INNER)])
            return F.least(inner[i], inner[i + (RUN - INNER)]) <= between

        def anchor(i: Column) -> Column:
            return _anchor(F.xxhash64(*[inner[i + k] for k in range(0, RUN - INNER + 1)]), i)

        return F.transform(F.filter(F.sequence(F.lit(0), n - RUN), closed), anchor)

    def or_whole(found: Column) -> Column:
        return F.when((F.size(found) == 0) & (n > 0), F.array(_anchor(F.xxhash64(words), 0))).otherwise(found)

    none = F.array().cast("array<struct<hash:bigint,place:int>>")
    return let(F.when(n < RUN, none).otherwise(let(inner, of_runs)), or_whole)


def all_anchors(text: Column) -> Column:
    """All anchors of a text as (hash, place), ascending, the first of each hash."""
    words = F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda w: F.xxhash64(w))

    def first_of_hash(found: Column) -> Column:
        return F.filter(found, lambda x, i: (i == 0) | (x["hash"] != F.get(found, i - 1)["hash"]))

    return let(F.sort_array(let(words, _anchors)), first_of_hash)


def as_text(anchors: Column) -> Column:
    """Hash and place as one number; what a place has beyond its bits there follows after a dot."""

    def number(x: Column) -> Column:
        low = x["place"].bitwiseAND(F.lit(2**PLACE_BITS - 1)).cast("long")
        beyond = F.shiftright(x["place"], PLACE_BITS)
        shown = F.lower(F.hex(F.shiftleft(x["hash"], PLACE_BITS).bitwiseOR(low)))
        return F.when(beyond == 0, shown).otherwise(F.concat(shown, F.lit("."), F.lower(F.hex(beyond))))

    return F.array_join(F.transform(anchors, number), " ")


def likeness(a: Column, b: Column) -> Column:
    """Share of the anchors of both that both have and that match by place.

    One sort brings equal hashes of the two side by side and another equal shifts, so sets of any size are compared.
    """

    def of_side(anchors: Column, side: int) -> Column:
        return F.transform(anchors, lambda x: F.struct(x["hash"].alias("hash"), F.lit(side).alias("side"), x["place"].alias("place")))

    def share(both: Column) -> Column:
        def shift(x: Column, i: Column) -> Column:
            after = F.get(both, i + 1)
            return F.when(after["hash"] == x["hash"], x["place"] - after["place"])

        def of_shifts(shifts: Column) -> Column:
            alike = lambda x, i: (F.size(shifts) == 1) | F.get(shifts, i - 1).eqNullSafe(x) | F.get(shifts, i + 1).eqNullSafe(x)
            total = F.size(both) - F.size(shifts)
            return F.when(total == 0, 1.0).otherwise(F.size(F.filter(shifts, alike)) / total)

        return let(F.sort_array(F.filter(F.transform(both, shift), lambda x: x.isNotNull())), of_shifts)

    both = F.sort_array(F.concat(of_side(a, 0), of_side(b, 1)))
    return let(both, share)


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with its fingerprint, that of its edited text, and their likeness."""
    text = docs.select("doc_id", F.xxhash64("doc_id").alias("id_hash"), F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text"))
    keys = text.select("doc_id", *_KEY, F.char_length("text").cast("long").alias("n_chars"))
    own = keys.groupBy(*_KEY).agg(F.first("doc_id").alias("doc_id"), F.first("n_chars").alias("n_chars"), F.count("*").alias("copies"))
    placed = materialize(ranked(own, [], ["doc_id", "text_hash"], "in-order", "at"), "placed")
    total = F.lit(max(placed.count(), 1))
    before = placed.select(F.pmod(F.col("at") + 1, total).alias("at"), *[F.col(c).alias(f"of_{c}") for c in (*_KEY, "doc_id", "n_chars", "copies")])
    links = materialize(before.join(placed.select("at", *_KEY), "at").drop("at"), "next-documents")

    text = text.groupBy(*_KEY).agg(F.first("text").alias("text"))
    ahead = text.join(links, _KEY).select(*[F.col(f"of_{c}").alias(c) for c in (*_KEY, "doc_id", "n_chars", "copies")], F.col("text").alias("next_text"))
    kept = F.substring("text", F.lit(1), F.ceil(F.col("n_chars") / 2).cast("int"))
    taken = F.substring("next_text", F.lit(1), F.floor(F.col("n_chars") / 2).cast("int"))
    out = ahead.join(text, _KEY).withColumn("edited", F.concat(kept, taken))

    def compared(own: Column, edited: Column, following: Column) -> Column:
        return F.struct(
            as_text(own).alias("fingerprint"),
            as_text(edited).alias("edited_fingerprint"),
            likeness(own, edited).alias("near_edited"),
            likeness(own, following).alias("near_next"),
        )

    of = [all_anchors(F.col(c)) for c in ("text", "edited", "next_text")]
    found = let(of[0], lambda x: let(of[1], lambda y: let(of[2], lambda z: compared(x, y, z))))
    # Inlined, as fields of a struct column would each compute it anew.
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.inline(F.array_repeat(found, F.col("copies").cast("int"))))


def op2_closed_syncmers(spark, sf_dir: str) -> DataFrame:
    return edited_pairs(documents(spark, sf_dir))
