"""Surrogates for personal data: keyed, of the same type and format, distinct, and the same wherever an entity recurs.

Found are mail addresses, IPv4 and IPv6 addresses, phone numbers with a country code or in local groups, card and social security
numbers, long digit strings, bank account numbers (IBAN), hexadecimal secrets of 32 digits and more, keys of well-known shapes, and names of
up to four words after a title. An entity's canonical form is what its spellings share (letters in lower case, digits without
punctuation); its surrogate is drawn from a keyed hash (HMAC) of type and canonical form, so equal entities
get equal surrogates in all documents, and is then written in the spelling of each place. Names keep the gender that
the title or the first occurrence shows, and their script. Where a document names someone with a title, the words of the name are
replaced wherever they stand in that document, also without the title. Names that never follow a title are not found.

The key comes from the caller, or from the setting `spark.filestrata.surrogateKey`. Without either a published one is used, which
hides nothing from those who know it: it is there for tests and registered queries.

The distinct entities, not the texts, are checked: if two have the same surrogate, or a surrogate is itself an entity, all
but one draw again, until none collide. Texts that a few cheap patterns show to have no entity are neither searched further nor
shuffled; the others meet their replacements by a join.
A null text stays null and has no entities. Rows come back as often as they went in; only DataFrame functions are used.
"""
from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.joins import lookup_join
from ..session import frozen
from . import frames

KEY = "filestrata"
KEY_SETTING = "spark.filestrata.surrogateKey"
#: Draws after which surrogates grow by a character each.
DRAWS = 40

# Titles before names, by gender.
MALE = "Mr|Herr|Monsieur|Señor|Sr|Signor|Господин|г-н"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Signora|Госпожа|г-жа"
ANY_GENDER = "Dr|Prof|Professor|Doctor|Dra|Docteur|Доктор|Проф"
_TITLES = f"{MALE}|{FEMALE}|{ANY_GENDER}"
_NAME = r"\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+){0,3}"
# A run of letters is walked once, not again from each of its letters; a domain has at most 127 labels.
_LOCAL = r"[\p{L}\p{N}._%+\-]"
_GROUP = "[0-9A-Fa-f]{1,4}"
PATTERNS = {
    "mail": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[\p{{L}}\p{{N}}\-]+(?:\.[\p{{L}}\p{{N}}\-]+){{0,125}}\.\p{{L}}{{2,}}",
    "ip6": rf"(?<![\p{{L}}\d:])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{2,6}}(?::{_GROUP}){{1,5}}|(?:{_GROUP}:)(?::{_GROUP}){{2,6}})(?![\p{{L}}\d:])",
    "ip": r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\d|\.\d)",
    "phone": r"\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{2,4})[ .\-]?\d{2,4}[ .\-]?\d{3,4}(?!\d)|(?<![\p{L}\d])\(\d{2,5}\)[ .\-]?\d{3,4}[ .\-]\d{3,4}(?!\d)",
    "iban": r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?:(?: [A-Z\d]{4}){2,7}(?: [A-Z\d]{1,3})?|[A-Z\d]{11,30})(?![\p{L}\d])",
    "token": r"(?<![\p{L}\d])(?:(?:AKIA|ASIA)[A-Z\d]{16}|gh[pousr]_[A-Za-z\d]{36,}|sk-[A-Za-z\d]{20,}|xox[abprs]-[A-Za-z\d\-]{10,})(?![\p{L}\d])",
    "secret": r"(?<![\p{L}\d])(?=[0-9A-Fa-f]{32})(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,}+(?![\p{L}\d])",
    "number": r"(?<![\p{L}\d])(?:\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}|\d{4}[ \-]\d{6}[ \-]\d{5}|\d{3}-\d{2}-\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4}|"
              r"0\d{2,4} \d{3,4} \d{3,4}|\d{13,19})(?![\p{L}\d])",
    "name": rf"(?<!\p{{L}})(?:{_TITLES})\.? {_NAME}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# Single characters, not ranges, in a class are looked up in a table.
_DIGITS, _HEX = "0123456789", "0123456789abcdefABCDEF"


def _title_signs() -> list[str]:
    """One pattern for the titles that begin with an ASCII letter, and one for each other first letter."""
    tails: dict[str, dict[str, None]] = {}
    for title in _TITLES.split("|"):
        tails.setdefault("[{}]" if title[0].isascii() else title[0], {})[title] = None
    return [rf"{head.format(''.join(sorted({t[0] for t in titles})))}(?:{'|'.join(t[1:] for t in titles)})\.? \p{{Lu}}" for head, titles in tails.items()]


#: Each entity holds a match of one of these, which begin with few characters and so pass over most of a text quickly.
SIGNS = [
    rf"[@+{_DIGITS}](?:(?<=@)[\p{{L}}\p{{N}}\-]|(?<=\+)\d|(?<=\d)[{_DIGITS}. \-]{{6}})", f"[{_HEX}][{_HEX}]{{31}}", *_title_signs(),
    f":[{_HEX}]{{0,4}}:[{_HEX}]", "AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-", "[A-Z][A-Z][0-9][0-9][A-Z0-9 ]{11}",
]
_SYLLABLES = "array('ba','den','fi','gor','hal','ke','lun','mar','ned','ol','per','rin','sa','tov','ul','ves','wil','ya','zen','cor')"
_CYRILLIC = "array('ба','ден','фи','гор','хал','ке','лун','мар','нед','ол','пер','рин','са','тов','ул','вес','вил','я','зен','кор')"


def _type(entity: str) -> str:
    """SQL for the type of a matched text."""
    return ("CASE WHEN {0} LIKE '%@%' THEN 'mail' WHEN {0} LIKE '+%' OR {0} LIKE '(%' THEN 'phone' WHEN {0} RLIKE '^[0-9.]+[.][0-9]+$' "
            "AND {0} NOT RLIKE '^[0-9]{{3}}[.][0-9]{{3}}[.][0-9]{{4}}$' THEN 'ip' WHEN {0} RLIKE '^[0-9. -]+$' THEN 'number' "
            "WHEN {0} RLIKE '^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$' THEN 'ip6' WHEN {0} RLIKE '^(AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-)' THEN 'token' "
            "WHEN {0} RLIKE '^[0-9A-Fa-f]{{32}}[0-9A-Fa-f]*$' THEN 'secret' WHEN {0} RLIKE '^[A-Z][A-Z][0-9][0-9][A-Z0-9 ]+$' THEN 'iban' ELSE 'name' END").format(entity)


def _signs() -> Column:
    """Whether `text` may have an entity; false only if it has none, or is null."""
    found = F.lit(False)
    for sign in SIGNS:
        found = found | F.col("text").rlike(sign)
    return F.coalesce(found, F.lit(False))


def entities(docs: DataFrame) -> DataFrame:
    """`doc_id, mark, place, found, type, title` of each match; mark is a hash of the text."""
    listed = docs.filter(_signs()).select(
        "doc_id", F.xxhash64("text").alias("mark"), F.posexplode(F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("place", "found"))
    title = F.regexp_extract("found", rf"^(?:{_TITLES})\.? ", 0)
    typed = listed.withColumn("type", F.expr(_type("found")))
    return typed.withColumn("title", F.when(F.col("type") == "name", title).otherwise(""))


def _forms(found: DataFrame) -> DataFrame:
    """One row per part that is replaced: names in their words, all else as a whole; with its kind and canonical form."""
    rest = F.expr("substring(found, length(title) + 1)")
    is_name = F.col("type") == "name"
    parts = found.withColumn("words", F.when(is_name, F.split(rest, " ")).otherwise(F.array(rest)))
    gender = F.when(F.col("title").rlike(rf"^(?:{MALE})\.? $"), "male").when(F.col("title").rlike(rf"^(?:{FEMALE})\.? $"), "female").otherwise("given")
    spelled = parts.select("doc_id", "mark", "place", "type", "title", F.size("words").alias("n_words"), F.posexplode("words").alias("word", "spelled"))
    # All words of a name but the last are given ones.
    kind = F.when(~is_name, F.col("type")).when(F.col("word") < F.col("n_words") - 1, gender).otherwise("family")
    canonical = (F.when(F.col("kind").isin("phone", "number"), F.regexp_replace("spelled", r"\D", ""))
                 .when(F.col("kind") == "iban", F.replace("spelled", F.lit(" "), F.lit(""))).when(F.col("kind") == "token", F.col("spelled"))
                 .otherwise(F.lower("spelled")))
    return spelled.withColumn("kind", kind).withColumn("canonical", canonical)


def _hmac(key: str, message: str) -> str:
    """SQL for the 128 hexadecimal digits of HMAC-SHA512 of a text."""
    secret = key.encode()
    secret = (hashlib.sha512(secret).digest() if len(secret) > 128 else secret).ljust(128, b"\0")
    inner, outer = (bytes(b ^ pad for b in secret).hex() for pad in (0x36, 0x5C))
    return f"sha2(concat(unhex('{outer}'), unhex(sha2(concat(unhex('{inner}'), encode({message}, 'UTF-8')), 512))), 512)"


def _drawn(key: str) -> Column:
    """The surrogate of `canonical` for `kind` at the `attempt`-th draw, in canonical spelling."""
    message = "concat(kind, '|', canonical, '|', attempt, '|', i)"
    # Later draws of all that has letters are longer, so that surrogates never run out.
    longer = f"IF(kind IN ('mail', 'secret', 'token'), greatest(0, attempt - {DRAWS}), 0)"
    # Two hexadecimal digits for each character, from as many hashes as the form is long.
    stream = f"concat_ws('', transform(sequence(0, (length(canonical) + {longer}) div 64), i -> {_hmac(key, message)}))"
    value = "int(conv(substring(s.stream, 2 * i - 1, 2), 16, 10))"
    spelled = f"""transform(sequence(1, length(canonical)), i -> CASE
        WHEN kind = 'mail' AND i >= length(canonical) - instr(reverse(canonical), '.') + 1 THEN substring(canonical, i, 1)
        WHEN kind = 'phone' AND i = 1 THEN substring(canonical, i, 1)
        WHEN kind = 'number' AND i = 1 THEN string(1 + {value} % 9)
        WHEN kind = 'iban' AND i <= 2 THEN substring(canonical, i, 1)
        WHEN kind = 'token' AND i <= 4 THEN substring(canonical, i, 1)
        WHEN kind = 'secret' THEN substring('0123456789abcdef', 1 + {value} % 16, 1)
        WHEN kind = 'ip6' AND substring(canonical, i, 1) <> ':' THEN substring('123456789abcdef', 1 + {value} % 15, 1)
        WHEN substring(canonical, i, 1) RLIKE '[0-9]' THEN string({value} % 10)
        WHEN substring(canonical, i, 1) RLIKE '[A-Z]' THEN char(65 + {value} % 26)
        WHEN substring(canonical, i, 1) RLIKE '\\\\p{{L}}' THEN char(97 + {value} % 26)
        ELSE substring(canonical, i, 1) END)"""
    more = f"concat_ws('', transform(sequence(length(canonical), length(canonical) + {longer}), i -> IF(i > length(canonical), substring('0123456789abcdef', 1 + {value} % 16, 1), '')))"
    octets = f"concat_ws('.', transform(sequence(1, 4), i -> string(IF(i = 1, 1 + {value} % 223, {value}))))"
    syllables = f"IF(canonical RLIKE '[\\u0400-\\u04FF]', {_CYRILLIC}, {_SYLLABLES})"
    # Later draws are longer, so that names never run out.
    stem = f"concat_ws('', transform(sequence(1, 2 + attempt div 4), i -> element_at({syllables}, 1 + {value} % 20)))"
    cyrillic = "canonical RLIKE '[\\u0400-\\u04FF]'"
    ending = (f"CASE kind WHEN 'female' THEN IF({cyrillic}, 'ина', 'ina') WHEN 'male' THEN IF({cyrillic}, 'ан', 'an') "
              f"WHEN 'given' THEN IF({cyrillic}, 'ель', 'el') ELSE IF({cyrillic}, 'енко', 'son') END")
    hyphen = f"IF(canonical LIKE '%-%', concat('-', element_at({syllables}, 1 + int(conv(substring(s.stream, 101, 2), 16, 10)) % 20), 'er'), '')"
    return F.expr(f"""element_at(transform(array(named_struct('stream', {stream})), s -> CASE
        WHEN kind IN ('male', 'female', 'given', 'family') THEN concat({stem}, {ending}, {hyphen}) WHEN kind = 'ip' THEN {octets}
        ELSE concat({more}, concat_ws('', {spelled})) END), 1)""")


def surrogates(forms: DataFrame, key: str = KEY) -> DataFrame:
    """`kind, canonical, surrogate` of the distinct entities; no two of a kind share one, and none is an entity itself.

    Formats of digits alone have 10 ** 7 surrogates at least; if more entities than that had one format, drawing would not end.
    """
    found = frozen(forms.select("kind", "canonical").distinct())
    current = frozen(found.withColumn("attempt", F.lit(0)).withColumn("surrogate", _drawn(key)))
    while True:
        # The smallest entity keeps a surrogate that several drew, unless it is an entity.
        owners = current.groupBy("kind", "surrogate").agg(F.min("canonical").alias("owner"), F.count("*").alias("n"))
        taken = found.select("kind", F.col("canonical").alias("surrogate"), F.lit(True).alias("real"))
        bad = owners.join(taken, ["kind", "surrogate"], "left").filter("n > 1 OR real").select(
            "kind", "surrogate", F.when(F.col("real").isNull(), F.col("owner")).alias("owner"))
        again = frozen(current.join(bad, ["kind", "surrogate"]).filter("owner IS NULL OR owner <> canonical").select("kind", "canonical", F.lit(1).alias("more")))
        if not again.take(1):
            return current.select("kind", "canonical", "surrogate")
        current = frozen(
            current.join(again, ["kind", "canonical"], "left")
            .select("kind", "canonical", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt")).withColumn("surrogate", _drawn(key)))


def _respelled() -> Column:
    """The surrogate in the spelling of the place: its punctuation, and its upper case."""
    digits = F.expr("""concat_ws('', transform(sequence(1, length(spelled)), i -> IF(substring(spelled, i, 1) RLIKE '[0-9]',
        substring(surrogate, length(regexp_replace(substring(spelled, 1, i), '[^0-9]', '')), 1), substring(spelled, i, 1))))""")
    letters = F.expr("""concat_ws('', transform(sequence(1, length(spelled)), i -> IF(substring(spelled, i, 1) = ' ', ' ',
        substring(surrogate, length(replace(substring(spelled, 1, i), ' ', '')), 1))))""")
    shouted = (F.col("spelled") == F.upper("spelled")) & (F.col("spelled") != F.lower("spelled"))
    titled = F.concat(F.upper(F.substring("surrogate", 1, 1)), F.expr("substring(surrogate, 2)"))
    return (F.when(F.col("kind").isin("phone", "number"), digits).when(F.col("kind") == "iban", letters).when(F.col("kind") == "token", F.col("surrogate")).when(shouted, F.upper("surrogate"))
            .when(F.col("type") == "name", titled).otherwise(F.col("surrogate")))


def _elsewhere(gap: Column) -> Column:
    """A piece of text between entities, with the words of the document's names replaced by `_surrogate_names`, a map of spellings."""
    runs = F.regexp_extract_all(gap, F.lit(r"\p{L}[\p{L}'-]*|[^\p{L}]+"), F.lit(0))
    return F.when(F.size("_surrogate_names") > 0, F.array_join(F.transform(runs, lambda run: F.coalesce(F.try_element_at("_surrogate_names", run), run)), "")).otherwise(gap)


def _replaced(docs: DataFrame, key: str | None) -> DataFrame:
    """`docs` with the entities in `text` replaced, and `_n_surrogates`."""
    if key is None:
        key = docs.sparkSession.conf.get(KEY_SETTING, KEY)
    forms = frozen(_forms(entities(docs.select("doc_id", "text"))))
    known = surrogates(forms, key)
    spelled = lookup_join(forms, known, ["kind", "canonical"], ["doc_id", "mark"]).withColumn("out", _respelled())
    # A name's title is written once, before its first word. Equal rows of a table give equal parts, hence sets.
    words = F.sort_array(F.collect_set(F.struct("word", "out")))
    whole = F.concat(F.first("title"), F.array_join(F.transform(words, lambda w: w["out"]), " ")).alias("out")
    # A word of a name by its spelling, also in capitals; a word that is both given and family name takes the lesser surrogate.
    named = F.when(F.col("type") == "name", F.struct(F.col("spelled").alias("word"), "out"))
    shouted = F.when(F.col("type") == "name", F.struct(F.upper("spelled").alias("word"), F.upper("out").alias("out")))
    by_place = spelled.groupBy("doc_id", "mark", "place").agg(whole, F.array_union(F.collect_set(named), F.collect_set(shouted)).alias("names"))
    # The list of a text's replacements is no longer than the text.
    by_text = by_place.groupBy("doc_id", "mark").agg(
        F.sort_array(F.collect_list(F.struct("place", "out"))).alias("_surrogate_parts"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("_words"))
    once = F.expr("filter(array_sort(_words), (w, i) -> i = 0 OR w.word <> array_sort(_words)[i - 1].word)")
    by_text = by_text.select(F.col("doc_id").alias("_surrogate_id"), F.col("mark").alias("_surrogate_mark"), "_surrogate_parts", F.map_from_entries(once).alias("_surrogate_names"))
    signs, names = _signs(), docs.columns
    keyed = docs.filter(signs)
    met = keyed.join(by_text, keyed["doc_id"].eqNullSafe(F.col("_surrogate_id")) & (F.xxhash64(keyed["text"]) == F.col("_surrogate_mark")), "left")
    gaps = F.transform(F.split("text", ANY, -1), _elsewhere)
    after = F.zip_with("_surrogate_parts", F.slice("_surrogate_gaps", F.lit(2), F.size("_surrogate_parts")), lambda part, gap: F.concat(part["out"], gap))
    text = F.when(F.col("_surrogate_parts").isNull(), F.col("text")).otherwise(F.concat(F.get("_surrogate_gaps", F.lit(0)), F.array_join(after, "")))
    made = met.withColumn("_surrogate_gaps", F.when(F.col("_surrogate_parts").isNotNull(), gaps)).select(
        *[text.alias(c) if c == "text" else F.col(c) for c in names], F.coalesce(F.array_size("_surrogate_parts"), F.lit(0)).cast("long").alias("_n_surrogates"))
    return docs.filter(~signs).withColumn("_n_surrogates", F.lit(0).cast("long")).unionByName(made)


def with_surrogates(docs: DataFrame, key: str | None = None) -> DataFrame:
    """`docs` with the entities in `text` replaced, and `n_entities`; all other columns stay, but for one of that name."""
    out = _replaced(docs, key)
    return out.drop("n_entities").withColumnRenamed("_n_surrogates", "n_entities")


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates in place of personal data."""
    return with_surrogates(frames.table(spark, sf_dir, "documents").select("doc_id", "text"))


def private_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`docs` with surrogates; the number of characters is that of the new text.

    Null and empty texts stay as they are, and so do rows and columns whatever their ids and names; an empty table stays empty.
    """
    out = _replaced(docs, None).drop("_n_surrogates")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
