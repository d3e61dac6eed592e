"""One consistent form for texts that look the same but differ in their characters.

Distinct values are exploded to positioned code points, broadcast-joined with a table of
decompositions, look-alike letters, spaces and invisible characters, their combining marks put in
canonical order and composed again, and the strings rebuilt. Code points below U+0080 map to
themselves, so a value of nothing else needs no work and runs of them are exploded as one piece.

The table follows Unicode's own data (``unicodedata``): canonical decompositions always,
compatibility ones only where the shape is the letter's own (font, width, presentation forms,
ligatures and spaces); a superscript, a fraction or a circled digit stays what it is.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.runtime import Stage

# Letters of other scripts with the shape of a Latin one.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T",
    "Х": "X", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ԁ": "D", "Ӏ": "I", "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h",
    "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "Χ": "X", "ο": "o", "ν": "v", "ρ": "p", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    # Armenian
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "Տ": "S", "Ս": "U", "Լ": "L",
    # Coptic
    "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "Ⲍ": "Z",
    # Lisu
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S", "ꓣ": "R",
    "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    # Latin outside ASCII: small capitals that are the small letters, and others
    "ᴄ": "c", "ᴏ": "o", "ꜱ": "s", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ᴜ": "u",
    # Cherokee
    "ɡ": "g", "ɑ": "a", "Ꭱ": "R", "Ꮍ": "Y", "Ꮒ": "h", "Ꮟ": "b", "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮴ": "V", "Ꮷ": "d", "Ꮖ": "I", "Ᏻ": "G", "Ꮳ": "G", "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M",
    "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # hyphens, the minus sign and the letter apostrophe, which is drawn as the closing quotation mark
    "‐": "-", "‑": "-", "−": "-", "ʼ": "’",
}

# Characters that draw nothing and change nothing around them.
INVISIBLE = frozenset(
    map(chr, [0xAD, 0x34F, 0x61C, 0x180E, 0x200B, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, *range(0x2060, 0x2065), *range(0x2066, 0x2070), 0xFEFF])
)
#: Tags of compatibility decompositions whose shape is the letter's own.
STYLES = {"<font>", "<wide>", "<narrow>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
JAMO = "[ᅡ-ᅵᆨ-ᇂ]"
#: Where joiners change what is drawn (Java character classes): Arabic letters that join to the next, viramas, emoji.
_JOINING = r"\p{IsArabic}&&[\p{L}\x{640}]&&[^اأإآٱدذرزژوؤةء]"
_VIRAMA = r"\x{94d}\x{9cd}\x{a4d}\x{acd}\x{b4d}\x{bcd}\x{c4d}\x{ccd}\x{d4d}\x{dca}"
_EMOJI = r"\x{1F000}-\x{1FAFF}\x{2190}-\x{2BFF}\x{FE0F}\x{E0020}-\x{E007F}"
IDLE_JOINER = (
    rf"(?<![{_JOINING}])(?<![{_VIRAMA}])\x{{200c}}|(?<=[{_JOINING}])\x{{200c}}(?![\p{{IsArabic}}])"
    rf"|(?<![\p{{IsArabic}}{_VIRAMA}])\x{{200d}}(?!\p{{IsArabic}})"
)
#: Stands for a joiner between emoji while idle ones go: Java's lookbehind can't see past U+FFFF.
_KEPT = "\ufdd0"


def _without_idle_joiners(value: Column) -> Column:
    kept = F.regexp_replace(value, rf"([{_EMOJI}])\x{{200d}}(?=[{_EMOJI}])", f"$1{_KEPT}")
    return F.when(value.rlike("[\u200c\u200d]"), F.translate(F.regexp_replace(kept, IDLE_JOINER, ""), _KEPT, "\u200d")).otherwise(value)


def _expand(ch: str) -> str:
    if ch in INVISIBLE:
        return ""
    if unicodedata.category(ch) == "Zs" and ch != " ":
        return " "
    tag, _, rest = unicodedata.decomposition(ch).rpartition("> ")
    parts = [chr(int(x, 16)) for x in rest.split()]
    own_shape = not tag or tag + ">" in STYLES or tag == "<compat" and (0xFB00 <= ord(ch) <= 0xFB4F or 0x2160 <= ord(ch) <= 0x217F)
    if parts and own_shape:
        return "".join(map(_expand, parts))
    return LOOKALIKES.get(ch, ch)


@lru_cache(1)
def character_table() -> list[tuple[str, str, list[int] | None]]:
    """(ch, to, classes) of each code point from U+0080 that maps to others or is a combining mark.

    classes has the canonical combining class of each character of ``to``; null if none is a mark
    or a conjoining jamo, that is if the piece can be used as it is.
    """
    rows = []
    for cp in [*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x110000)]:
        ch = chr(cp)
        to = _expand(ch)
        classes = [unicodedata.combining(c) for c in to]
        special = any(classes) or any("ᅡ" <= c <= "ᅵ" or "ᆨ" <= c <= "ᇂ" for c in to)
        if to != ch or special:
            rows.append((ch, to, classes if special else None))
    return rows


@lru_cache(1)
def _pairs() -> dict[str, str]:
    """First character and mark -> composed character, for Unicode's canonical compositions."""
    out = {}
    for cp in range(0xC0, 0x30000):
        if 0xAC00 <= cp < 0xE000:
            continue
        two = unicodedata.decomposition(ch := chr(cp)).split()
        if len(two) == 2 and two[0][0] != "<" and unicodedata.normalize("NFC", ch) == ch and unicodedata.combining(chr(int(two[1], 16))):
            out["".join(chr(int(x, 16)) for x in two)] = ch
    return out


def _hangul() -> list[tuple[str, str]]:
    lead, vowel, tail = range(0x1100, 0x1113), range(0x1161, 0x1176), range(0x11A7, 0x11C3)
    rows = []
    for a in lead:
        for b in vowel:
            lv = chr(0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28)
            for c in tail:
                end = "" if c == 0x11A7 else chr(c)
                rows.append((chr(a) + chr(b) + end, chr(ord(lv) + c - 0x11A7)))
                if end:
                    rows.append((lv + end, chr(ord(lv) + c - 0x11A7)))
    return rows


def _compose(cluster: Column) -> Column:
    """A starter (the last character of its piece) with its ordered marks, composed as far as canonical composition goes."""
    pairs = F.create_map(*[F.lit(x) for kv in _pairs().items() for x in kv])
    first = cluster[0]["c"]
    start = F.struct(
        F.substring(first, F.lit(1), F.length(first) - 1).alias("head"),
        F.substring(first, F.length(first), F.lit(1)).alias("base"),
        F.lit("").alias("rest"),
        F.lit(0).alias("k"),
    )

    def add(acc: Column, m: Column) -> Column:
        made = F.when((acc["rest"] == "") | (acc["k"] < m["k"]), F.element_at(pairs, F.concat(acc["base"], m["c"])))
        return F.struct(
            acc["head"].alias("head"),
            F.coalesce(made, acc["base"]).alias("base"),
            F.when(made.isNull(), F.concat(acc["rest"], m["c"])).otherwise(acc["rest"]).alias("rest"),
            F.when(made.isNull(), m["k"]).otherwise(acc["k"]).alias("k"),
        )

    return F.aggregate(F.slice(cluster, F.lit(2), F.greatest(F.size(cluster) - 1, F.lit(0))), start, add, lambda s: F.concat(s["head"], s["base"], s["rest"]))


def canonical_forms(values: DataFrame, stage: Stage) -> DataFrame:
    """(value, canon) of the distinct non-ASCII strings of ``values(value)``."""
    spark = values.sparkSession
    table = F.broadcast(spark.createDataFrame(character_table(), "ch string, to string, classes array<int>"))  # fixed by Unicode: about 5,000 rows
    other = values.where(F.col("value").rlike(r"[^\x00-\x7F]")).select("value").distinct()
    # by code point, runs of ASCII in one piece
    pieces = other.select("value", F.posexplode(F.regexp_extract_all(_without_idle_joiners(F.col("value")), F.lit(r"(?s)[\x00-\x7F]+|."), F.lit(0))).alias("pos", "ch"))
    mapped = pieces.join(table, "ch", "left").select("value", "pos", F.coalesce("to", "ch").alias("to"), "classes")
    rows = stage.put(
        mapped.groupBy("value").agg(F.sort_array(F.collect_list(F.struct("pos", "to", "classes"))).alias("els"), F.max(F.col("classes").isNotNull()).alias("marked"))
    )
    plain = rows.where("not marked").select("value", F.array_join(F.transform("els", lambda e: e["to"]), "").alias("canon"))
    chars = (
        rows.where("marked")
        .select("value", F.explode("els").alias("e"))
        .select(
            "value",
            F.col("e.pos").alias("pos"),
            F.posexplode(
                F.when(F.col("e.classes").isNull(), F.array(F.struct(F.col("e.to").alias("c"), F.lit(0).alias("k")))).otherwise(
                    F.zip_with(F.regexp_extract_all(F.col("e.to"), F.lit("(?s)."), F.lit(0)), F.col("e.classes"), lambda c, k: F.struct(c.alias("c"), k.alias("k")))
                )
            ).alias("sub", "x"),
        )
        .select("value", "pos", "sub", "x.c", "x.k")
        .where("c <> ''")
    )
    starts = ((F.col("k") == 0) & ~F.col("c").rlike(f"^{JAMO}$")).cast("int")
    grouped = chars.withColumn("grp", F.sum(starts).over(Window.partitionBy("value").orderBy("pos", "sub")))
    clusters = grouped.groupBy("value", "grp").agg(F.sort_array(F.collect_list(F.struct("k", "pos", "sub", "c"))).alias("cl"))
    jamo = F.broadcast(spark.createDataFrame(_hangul(), "joined string, syllable string"))  # fixed by Unicode
    built = clusters.select("value", "grp", F.when(F.size("cl") == 1, F.col("cl")[0]["c"]).otherwise(_compose(F.col("cl"))).alias("s"))
    # a lead consonant may end a longer ASCII-free piece only if it is the piece
    made = built.join(jamo, F.col("s") == F.col("joined"), "left").select("value", "grp", F.coalesce("syllable", "s").alias("s"))
    marked = made.groupBy("value").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("grp", "s"))), lambda e: e["s"]), "").alias("canon"))
    # a value of invisible characters only has no element left
    empty = rows.where("marked").select("value").join(marked.select("value"), "value", "left_anti").select("value", F.lit("").alias("canon"))
    return stage.put(plain.union(marked).union(empty))


def with_canonical(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with each named string column in its consistent form; nulls and empty strings stay."""
    stage = Stage(rows.sparkSession, "canon")
    values = None
    for c in columns:
        one = rows.select(F.col(c).alias("value"))
        values = one if values is None else values.union(one)
    forms = canonical_forms(values, stage)
    for c in columns:
        f = forms.select(F.col("value").alias(f"__value_{c}"), F.col("canon").alias(f"__canon_{c}"))
        rows = rows.join(f, F.col(c) == F.col(f"__value_{c}"), "left").withColumn(c, F.coalesce(f"__canon_{c}", c)).drop(f"__value_{c}", f"__canon_{c}")
    return rows


def equal_looking_pairs(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(field, pos_a, pos_b), pos_a < pos_b, of rows whose non-empty values look the same and differ.

    Nulls and empty strings pair with nothing, equal strings are no pair, and values that are
    invisible altogether pair among themselves. Work is by distinct value; rows of one look come
    together only where at least two spellings of it exist.
    """
    stage = Stage(rows.sparkSession, "lookalikes")
    long = rows.select(F.col(key).alias("pos"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns])).alias("x")).select("pos", "x.field", "x.value").where("value is not null and value <> ''")
    forms = canonical_forms(long, stage)
    # spellings: distinct values by look and field, only of looks that some non-ASCII value has
    spelled = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    looks = spelled.join(forms, "value", "left").select("field", "value", F.coalesce("canon", "value").alias("canon"))
    several = looks.groupBy("field", "canon").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo <> hi").select("field", "canon")
    variants = stage.put(looks.join(several, ["field", "canon"], "left_semi"))
    hits = stage.put(long.join(variants, ["field", "value"]).select("field", "canon", "value", "pos"))
    a = hits.select("field", "canon", F.col("value").alias("va"), F.col("pos").alias("pos_a"))
    b = hits.select("field", "canon", F.col("value").alias("vb"), F.col("pos").alias("pos_b"))
    return a.join(b, ["field", "canon"]).where("pos_a < pos_b and va <> vb").select("field", "pos_a", "pos_b")


def look_classes(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, look, n_spellings, n_rows) of each look that at least two different non-empty values share: the pairs' classes, one row each."""
    stage = Stage(rows.sparkSession, "looks")
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns])).alias("x")).select("x.field", "x.value").where("value is not null and value <> ''")
    spelled = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    looks = spelled.join(canonical_forms(long, stage), "value", "left").groupBy("field", F.coalesce("canon", "value").alias("look"))
    return looks.agg(F.count(F.lit(1)).alias("n_spellings"), F.sum("n").alias("n_rows")).where("n_spellings > 1")
