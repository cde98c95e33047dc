r"""Surrogates for personal data, in DataFrame functions only.

Detected entities are replaced by made-up ones of the same type, format, script and gender.
A surrogate depends on a secret key and the normalised entity alone, so an
entity has the same one in every document and in every way of writing it.  All distinct entities and their
surrogates are then checked against each other: no two share a surrogate and none equals a
real entity of the corpus; those that do draw again, round by round, until none is left.

Texts are read three times and only those with an entity are shuffled, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfledger.llm.common import drop_table, write_table

FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία")
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
#: Titles of either gender: their names get endings of neither.
NEUTRAL = ("Dr", "Prof", "Mx", "Доктор", "Профессор")


def _titles(names: tuple[str, ...]) -> str:
    """The titles as written here or in capitals."""
    return "|".join(dict.fromkeys(form for name in names for form in (name, name.upper())))


_TITLE = _titles((*FEMALE, *MALE, *NEUTRAL))

#: Patterns by type; the first that fits a mention names its type.  Their repeated groups are possessive, so a
#: match needs no stack, and long runs are bounded: a local part of 64 characters, labels of 63, keys of 512.
PATTERNS = {
    "email": r"(?<![\p{L}\d._%+-])[\p{L}\d._%+-]{1,64}+@[\p{L}\d-]{1,63}+(?:\.[\p{L}\d-]{1,63}+){1,126}+",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9]{20,512}+|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])",
    "hex": r"(?<![A-Za-z0-9])(?=[a-fA-F]{0,512}\d)[0-9a-fA-F]{32,512}+(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
    "phone": r"(?<![\d(+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\d)"
    r"|(?<![\d+])\+\d{8,15}(?!\d)",
    "name": rf"(?<![\p{{L}}\d])(?:{_TITLE})\.? \p{{Lu}}[\p{{L}}'-]++(?: \p{{Lu}}[\p{{L}}'-]++)?(?![\p{{L}}\d])",
}
ENTITY = "|".join(PATTERNS.values())
#: Cheap tests, one of which every text with an entity other than a name passes.
HINT = r"[0-9@]"
KEY_MARKS = ("AKIA", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")

#: Syllables and endings of made-up names, by script; more syllables are drawn at each new round.
SYLLABLES = {
    "latin": ("ba", "do", "fe", "ga", "hel", "ka", "lo", "mar", "ne", "ol", "pe", "ra", "sel", "to", "va", "wil"),
    "cyrillic": ("ба", "ве", "го", "ди", "ка", "ла", "ми", "но", "пе", "ра", "со", "та", "фе", "ша", "ру", "зи"),
    "greek": ("βα", "γε", "δο", "κα", "λι", "μα", "νε", "πο", "ρα", "σι", "τα", "φε", "χα", "ζη", "θε", "λου"),
}
ENDINGS = {
    ("latin", "f"): "na", ("latin", "m"): "ron",
    ("cyrillic", "f"): "на", ("cyrillic", "m"): "н",
    ("greek", "f"): "να", ("greek", "m"): "νος",
    ("latin", "n"): "li", ("cyrillic", "n"): "ко", ("greek", "n"): "ου",
}
MAX_ROUNDS = 50
#: From this round on, addresses and social security numbers come from their whole range.
WIDE_ROUND = 5


# --- detection ------------------------------------------------------------------------------


def mentions(text: Column) -> Column:
    """All entities of a text as written, in order; empty for null."""
    found = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    none = F.array().cast("array<string>")
    hint = text.rlike(HINT) | text.rlike(PATTERNS["name"])
    for mark in KEY_MARKS:
        hint = hint | text.contains(mark)
    return F.coalesce(F.when(hint, found), none)


def entity_type(mention: Column) -> Column:
    kind = F.lit("name")
    for name, pattern in reversed(list(PATTERNS.items())):
        if name != "name":
            kind = F.when(mention.rlike(rf"^(?:{pattern})$"), F.lit(name)).otherwise(kind)
    return kind


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _name(mention: Column) -> Column:
    return F.regexp_replace(mention, rf"^(?:{_TITLE})\.? ", "")


def _gender(mention: Column) -> Column:
    female = mention.rlike(rf"^(?:{_titles(FEMALE)})\.? ")
    neutral = mention.rlike(rf"^(?:{_titles(NEUTRAL)})\.? ")
    return F.when(female, F.lit("f")).when(neutral, F.lit("n")).otherwise(F.lit("m"))


def _script(text: Column) -> Column:
    return (
        F.when(text.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic"))
        .when(text.rlike(r"\p{IsGreek}"), F.lit("greek"))
        .otherwise(F.lit("latin"))
    )


def normalised(kind: Column, mention: Column) -> Column:
    """What all ways of writing an entity have in common."""
    name = F.lower(_name(mention))
    return (
        F.when(kind.isin("card", "ssn"), _digits(mention))
        .when(kind == "phone", F.concat(F.when(mention.startswith("+"), "+").otherwise(""), _digits(mention)))
        .when(kind.isin("email", "hex"), F.lower(mention))
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .when(kind == "name", F.concat_ws("|", _gender(mention), _script(mention), name))
        .otherwise(mention)
    )


# --- surrogates -----------------------------------------------------------------------------


class _Stream:
    """Keyed bytes for an entity and a round."""

    def __init__(self, key: str, kind: Column, norm: Column, round_: Column, length: Column):
        parts = [F.lit(key), kind, norm, round_.cast("string")]
        last = (length / 32).cast("int")
        blocks = F.transform(
            F.sequence(F.lit(0), last),
            lambda k: F.sha2(F.concat_ws("\x1f", *parts, k.cast("string")), 256),
        )
        self.hex = F.array_join(blocks, "")

    def byte(self, k: Column | int) -> Column:
        at = (F.lit(k) if isinstance(k, int) else k) * 2 + 1
        return F.conv(self.hex.substr(at.cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), (n % len(letters) + 1).cast("int"), F.lit(1))


def _shaped(norm: Column, stream: _Stream, keep: int = 0) -> Column:
    """Letter for letter and digit for digit; the first ``keep`` characters stay."""

    def char(k: Column) -> Column:
        c, n = F.substring(norm, k, F.lit(1)), stream.byte(k)
        return (
            F.when(k <= keep, c)
            .when(c.rlike("[0-9]"), _pick("0123456789", n))
            .when(c.rlike(r"\p{Lu}"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n))
            .when(c.rlike(r"\p{L}"), _pick("abcdefghijklmnopqrstuvwxyz", n))
            .otherwise(c)
        )

    return _by_char(norm, char)


def _by_char(text: Column, char) -> Column:
    places = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text)))
    return F.coalesce(F.array_join(F.transform(places, char), ""), F.lit(""))


def luhn_rest(digits: Column) -> Column:
    """Luhn sum modulo ten; 0 marks a valid card number."""
    n = F.length(digits)

    def value(k: Column) -> Column:
        d = F.substring(digits, k, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when((n - k) % 2 == 1, twice).otherwise(d)

    total = F.aggregate(
        F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, b: (a + b).cast("int")
    )
    return total % 10


def _card(norm: Column, stream: _Stream) -> Column:
    drawn = _shaped(norm, stream, keep=1)
    body = F.substring(drawn, F.lit(1), F.length(norm) - 1)
    check = (F.lit(10) - luhn_rest(F.concat(body, F.lit("0")))) % 10
    return F.when(luhn_rest(norm) == 0, F.concat(body, check.cast("string"))).otherwise(drawn)


def _syllables(stream: _Stream, script: str, start: int, count: Column) -> Column:
    pool = F.array(*map(F.lit, SYLLABLES[script]))
    parts = F.transform(
        F.sequence(F.lit(start), F.lit(start) + count - 1),
        lambda k: F.get(pool, stream.byte(k) % len(SYLLABLES[script])),
    )
    return F.array_join(parts, "")


def _made_up_name(key: str, norm: Column, round_: Column) -> Column:
    """Given name by its own hash, surname by its own: parts are consistent by themselves."""
    part = F.split(norm, r"\|")
    gender, script, name = F.get(part, 0), F.get(part, 1), F.get(part, 2)
    surname = F.substring_index(name, " ", -1)
    given = F.when(name.contains(" "), F.substring_index(name, " ", 1))
    out = F.lit(None).cast("string")
    for which in SYLLABLES:
        own = _Stream(key, F.lit("surname"), surname, round_, F.lit(200))
        last = F.initcap(_syllables(own, which, 0, F.least(round_ + 3, F.lit(80))))
        if which == "cyrillic":  # surnames that show a gender go on showing it
            shows = surname.rlike("(?:ова|ева|ина|ая)$")
            last = F.concat(last, F.when(shows, F.lit("ова")).otherwise(F.lit("")))
        half = _Stream(key, F.lit("second surname"), surname, round_, F.lit(200))
        second = F.initcap(_syllables(half, which, 0, F.lit(2)))
        last = F.when(surname.rlike(r"\p{L}-\p{L}"), F.concat_ws("-", last, second)).otherwise(last)
        for sex in ("f", "m", "n"):
            first = _Stream(key, F.lit(f"given {sex}"), given, F.lit(0), F.lit(20))
            called = F.initcap(F.concat(_syllables(first, which, 0, F.lit(2)), F.lit(ENDINGS[which, sex])))
            full = F.when(given.isNull(), last).otherwise(F.concat_ws(" ", called, last))
            out = F.when((script == which) & (gender == sex), full).otherwise(out)
    return out


def surrogate(key: str, kind: Column, norm: Column, round_: Column) -> Column:
    """Normalised surrogate of a normalised entity."""
    stream = _Stream(key, kind, norm, round_, F.length(norm) + 8)
    octet = [stream.byte(k).cast("string") for k in (0, 1, 2)]
    # Private addresses and unissued numbers first; entities that find them taken draw from all.
    wide = round_ >= WIDE_ROUND
    network = F.when(wide, F.lit(1) + stream.byte(3) % 223).otherwise(F.lit(10)).cast("string")
    local = F.substring_index(norm, "@", 1)
    host = (stream.byte(F.length(norm) + 1) * 256 + stream.byte(F.length(norm) + 2)).cast("string")
    domain = F.get(F.array(F.lit("com"), F.lit("org"), F.lit("net")), stream.byte(F.length(norm) + 3) % 3)
    hexes = _by_char(norm, lambda k: _pick("0123456789abcdef", stream.byte(k)))
    return (
        F.when(kind == "email", F.concat(_shaped(local, stream), F.lit("@mail"), host, F.lit(".example."), domain))
        .when(kind == "hex", hexes)
        .when(kind == "key", _shaped(norm, stream, keep=4))
        .when(kind == "iban", _shaped(norm, stream, keep=2))
        .when(kind == "ip", F.concat_ws(".", network, *octet))
        .when((kind == "ssn") & wide, _shaped(norm, stream))
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(_shaped(norm, stream), 2, 99)))
        .when(kind == "card", _card(norm, stream))
        .when(kind == "phone", _shaped(norm, stream, keep=2))
        .otherwise(_made_up_name(key, norm, round_))
    )


def as_entity(kind: Column, norm: Column, drawn: Column) -> Column:
    """A surrogate in the form of a normalised entity, to compare the two."""
    part = F.split(norm, r"\|")
    name = F.concat_ws("|", F.get(part, 0), F.get(part, 1), F.lower(drawn))
    return F.when(kind == "name", name).otherwise(drawn)


def rendered(kind: Column, mention: Column, drawn: Column) -> Column:
    """The surrogate in the format of one mention: grouping, punctuation, case and title."""
    digits = _digits(drawn)

    def fill(source: Column, pattern: str):
        def char(k: Column) -> Column:
            c = F.substring(mention, k, F.lit(1))
            before = F.length(F.regexp_replace(F.substring(mention, F.lit(1), k), pattern, ""))
            return F.when(c.rlike(pattern), c).otherwise(F.substring(source, before, F.lit(1)))

        return _by_char(mention, char)

    body = F.regexp_extract(mention, rf"^(?:{_TITLE})\.? ", 0)
    loud = (mention == F.upper(mention)) & (mention != F.lower(mention))
    return (
        F.when(kind.isin("card", "ssn", "phone"), fill(digits, r"[^0-9]"))
        .when(kind == "iban", fill(drawn, " "))
        .when((kind == "name") & loud, F.concat(body, F.upper(drawn)))
        .when(kind == "name", F.concat(body, drawn))
        .when(kind.isin("email", "hex") & loud, F.upper(drawn))
        .otherwise(drawn)
    )


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, drawn) for the distinct (kind, norm): drawn again until nothing collides.

    Of entities that drew the same surrogate, the one of the earliest round keeps it, ties by
    the smaller entity.  Each round is written to the shared folder.
    """
    spark = entities.sparkSession
    current = entities.select("kind", "norm", F.lit(0).alias("round")).distinct()
    path = None
    for _ in range(MAX_ROUNDS):
        drawn = current.withColumn("drawn", surrogate(key, F.col("kind"), F.col("norm"), F.col("round")))
        drawn = drawn.withColumn("shown", as_entity(F.col("kind"), F.col("norm"), F.col("drawn")))
        table, table_path = write_table(drawn)
        if path:
            drop_table(spark, path)
        path = table_path
        first = table.groupBy("kind", "shown").agg(
            F.min_by("norm", F.struct("round", "norm")).alias("keeper")
        )
        real = table.select("kind", F.col("norm").alias("shown"), F.lit(True).alias("real"))
        checked = table.join(first, ["kind", "shown"]).join(real, ["kind", "shown"], "left")
        checked = checked.withColumn(
            "collides", (F.col("keeper") != F.col("norm")) | F.coalesce("real", F.lit(False))
        )
        if checked.filter("collides").isEmpty():
            return table.select("kind", "norm", "drawn")
        again = F.col("round") + F.col("collides").cast("int")
        current = checked.select("kind", "norm", again.alias("round"))
    raise RuntimeError("surrogates still collide; the pools of made-up names are too small")


# --- operator -------------------------------------------------------------------------------


def _marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.withColumns(
        {
            "__mentions": mentions(F.col(text)),
            "__mark": F.xxhash64(F.col(doc_id), F.col(text)),
        }
    )


def entity_mentions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, place, mention, kind, norm) of every entity; ``mark`` tells texts of an id apart."""
    found = _marked(docs.select(doc_id, text), doc_id, text).filter(F.size("__mentions") > 0)
    found = found.dropDuplicates([doc_id, "__mark"])
    found = found.select(
        F.col(doc_id).alias("doc_id"),
        F.col("__mark").alias("mark"),
        F.posexplode("__mentions").alias("place", "mention"),
    )
    found = found.withColumn("kind", entity_type(F.col("mention")))
    return found.withColumn("norm", normalised(F.col("kind"), F.col("mention")))


def replaced(
    docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The documents with surrogates in place of entities, and what was replaced.

    The first frame has all rows and columns of ``docs``; only ``text`` changes.  The second has
    doc_id, place, kind, mention and surrogate of each entity.  Null and empty texts stay as they
    are, repeated rows are treated alike, and a null id is a value like any other.  An empty table gives two empty
    frames.  Texts of any length are searched whole.  Columns that begin with two underscores are
    for the operator itself; all others may have any name.
    """
    found, _ = write_table(entity_mentions(docs, doc_id, text))
    table = surrogate_table(found, key)
    shown = found.join(table, ["kind", "norm"]).select(
        "doc_id", "mark", "place", "kind", "mention",
        rendered(F.col("kind"), F.col("mention"), F.col("drawn")).alias("surrogate"),
    )
    shown, _ = write_table(shown)
    by_doc = shown.groupBy("doc_id", "mark").agg(
        F.array_sort(F.collect_list(F.struct("place", "surrogate"))).alias("__new")
    )
    by_doc = by_doc.select(
        F.col("doc_id").alias("__doc"), F.col("mark").alias("__of"), F.col("__new.surrogate").alias("__new")
    )
    marked = _marked(docs, doc_id, text)
    plain = marked.filter(F.size("__mentions") == 0).select(*docs.columns)
    touched = marked.filter(F.size("__mentions") > 0).drop("__mentions")
    touched = touched.join(
        by_doc, touched[doc_id].eqNullSafe(by_doc["__doc"]) & (F.col("__mark") == F.col("__of"))
    )
    pieces = F.split(F.col(text), ENTITY, -1)
    joined = F.array_join(
        F.zip_with(F.concat(F.array(F.lit("")), F.col("__new")), pieces, lambda new, piece: F.concat(new, piece)), ""
    )
    touched = touched.withColumn(text, joined).select(*docs.columns)
    return plain.unionByName(touched), shown.drop("mark")
