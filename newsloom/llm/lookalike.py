"""Text that looks the same in one consistent form.

DuckDB runs inside Arrow partitions (`mapInArrow`): one embedded SQL expression drops invisible
characters, translates compatibility forms, blanks and look-alikes, and composes with
`nfc_normalize`. Case, accents and visibly different marks (raised or circled digits) stay.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import durable

# Latin letters and the Greek and Cyrillic letters drawn the same way.
LOOK_ALIKE_LETTERS = {
    "A": "ΑА", "B": "ΒВ", "C": "СϹ", "E": "ΕЕ", "F": "Ϝ", "G": "Ԍ", "H": "ΗН", "I": "ΙІӀ", "J": "ЈͿ", "K": "ΚК", "M": "ΜМ",
    "N": "Ν", "O": "ΟО", "P": "ΡР", "Q": "Ԛ", "S": "Ѕ", "T": "ΤТ", "W": "Ԝ", "X": "ΧХ", "Y": "ΥҮ", "Z": "Ζ",
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "іι", "j": "јϳ", "l": "ӏ", "o": "оο", "p": "рρ", "q": "ԛ",
    "s": "ѕ", "u": "υ", "v": "νѵ", "w": "ԝ", "x": "х", "y": "у",
}
# Signs drawn the same way.
LOOK_ALIKE_SIGNS = {
    "-": "‐‑‒–−﹣⁃", "·": "‧∙⋅・•᛫•ꞏ", "'": "’‘ʼ′＇", '"': "“”″", "/": "∕⁄", ":": "∶꞉", "*": "∗", "|": "∣ǀ", "~": "∼〜", "!": "ǃ",
}
#: Rows (field, id) that are broadcast at most, about 20 MB.
BROADCAST_ROWS = 200_000
BLANKS = "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85                 　"
INVISIBLE = (
    r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}"
    r"\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{1D173}-\x{1D17A}\x{E0000}-\x{E0FFF}"
    r"\x{0000}-\x{0008}\x{000E}-\x{001B}\x{007F}-\x{0084}\x{0086}-\x{009F}]"
)


@cache
def translation() -> tuple[str, str]:
    """(from, to) of equal length. Built by rules: width variants and radicals from the Unicode
    decompositions, look-alikes from the lists above, and every accented look-alike letter from its
    base letter, so that a precomposed Cyrillic letter meets the Latin one."""
    pairs: dict[str, str] = {}
    for block in (range(0x2E80, 0x2FE0), range(0x3000, 0x3001), range(0xFF01, 0xFFEF), range(0xFE30, 0xFE70)):
        for cp in block:
            kind, _, rest = unicodedata.decomposition(chr(cp)).partition(" ")
            whole = unicodedata.normalize("NFKC", chr(cp))
            if kind in ("<wide>", "<narrow>", "<small>", "<vertical>") or kind == "<compat>" and 0x2E80 <= cp < 0x2FE0:
                if len(whole) == 1 and rest:
                    pairs[chr(cp)] = whole
    for latin, same in [*LOOK_ALIKE_LETTERS.items(), *LOOK_ALIKE_SIGNS.items()]:
        for ch in same:
            if ch != latin:
                pairs[ch] = latin
    marks = [chr(cp) for cp in range(0x0300, 0x0345)]
    for latin, same in LOOK_ALIKE_LETTERS.items():
        for ch in same:
            for mark in marks:
                one, other = unicodedata.normalize("NFC", ch + mark), unicodedata.normalize("NFC", latin + mark)
                if len(one) == len(other) == 1:
                    pairs[one] = other
    pairs |= dict.fromkeys(BLANKS, " ")
    for ch, to in list(pairs.items()):  # a wide form of a look-alike sign goes all the way
        pairs[ch] = pairs.get(to, to)
    return "".join(pairs), "".join(pairs.values())


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@cache
def look_sql(column: str = "raw") -> str:
    """The DuckDB expression. Composing comes last, as dropping an invisible character or
    translating a letter can bring a letter and its combining accent together; canonical singletons
    (CJK compatibility ideographs) are resolved by it too."""
    source, target = translation()
    visible = f"regexp_replace({column}, {_quote(INVISIBLE)}, '', 'g')"
    return f"trim(nfc_normalize(translate({visible}, {_quote(source)}, {_quote(target)})), ' ')"


def _normalise(batches: Iterator) -> Iterator:
    import duckdb
    import pyarrow as pa

    con = duckdb.connect(config={"threads": 1})
    sql = f"SELECT * EXCLUDE (look), {look_sql('raw')} AS look FROM rows"
    for batch in batches:
        con.register("rows", pa.Table.from_batches([batch]))
        result = con.sql(sql)
        out = result.to_arrow_table() if hasattr(result, "to_arrow_table") else result.arrow()
        names = [f for f in batch.schema.names if f != "look"] + ["look"]
        kinds = pa.schema([(n, batch.schema.field(n).type) for n in names])
        yield from out.select(names).cast(kinds).to_batches()
        con.unregister("rows")


def with_look(texts: DataFrame, column: str = "raw", output: str = "look") -> DataFrame:
    """Adds `output`, the form of `column` in which texts that look the same are equal.

    Null stays null; empty, blank and only invisible text becomes empty. Whole texts are read,
    whatever their length. Other columns pass through; a column that has the output's name is
    replaced.
    """
    others = [c for c in texts.columns if c not in (column, output)]
    packed = texts.select(F.struct(*others).alias("kept") if others else F.lit(1).alias("kept"), F.col(column).alias("raw"))
    packed = packed.withColumn("look", F.lit(None).cast("string"))
    done = packed.mapInArrow(_normalise, packed.schema)
    return done.select(*([f"kept.`{c}`" for c in others]), F.col("raw").alias(column), F.col("look").alias(output))


def look_alike_pairs(strings: DataFrame) -> DataFrame:
    """Pairs of different ids whose strings look the same and yet differ in characters.

    `strings` has (field, id, raw). Returns (field, id_a, id_b), id_a < id_b, without repeats.
    Only groups with several spellings go on; spellings are paired first and then expanded to ids,
    so that a hot spelling (a third of all rows) meets only the other spellings, never itself. Null
    ids or strings are left out; strings that look empty too, as there is nothing to see.
    """
    given = strings.select("field", "id", "raw").where("id IS NOT NULL AND raw IS NOT NULL")
    # every string is normalised once and leaves only hashes; a collision only lets a group go on
    hashed = with_look(given).where("look <> ''").select("field", "id", F.xxhash64("field", "look").alias("k"), F.xxhash64("raw").alias("r"))
    hashed = durable(hashed, "looks")
    mixed = hashed.groupBy("k").agg(F.min("r").alias("lo"), F.max("r").alias("hi")).where("lo <> hi").select("k")
    some = durable(hashed.join(mixed, "k", "left_semi").select("field", "id").distinct(), "mixed")
    # strings stay where they are read if the ids that go on are few, and are counted
    wanted = F.broadcast(some) if some.count() <= BROADCAST_ROWS else some
    looked = with_look(given.join(wanted, ["field", "id"], "left_semi")).where("look <> ''")
    rows = durable(looked.select("field", "look", "raw", "id").distinct(), "lookalike")
    spellings = rows.select("field", "look", "raw").distinct()
    a, b = spellings.withColumnRenamed("raw", "raw_x"), spellings.withColumnRenamed("raw", "raw_y")
    twins = a.join(b, ["field", "look"]).where("raw_x < raw_y").select("field", "raw_x", "raw_y")
    x = rows.select("field", F.col("raw").alias("raw_x"), F.col("id").alias("id_x"))
    y = rows.select("field", F.col("raw").alias("raw_y"), F.col("id").alias("id_y"))
    pairs = twins.join(x, ["field", "raw_x"]).join(y, ["field", "raw_y"]).where("id_x <> id_y")
    return pairs.select("field", F.least("id_x", "id_y").alias("id_a"), F.greatest("id_x", "id_y").alias("id_b")).distinct()
