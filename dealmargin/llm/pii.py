"""PII: detected entities get keyed surrogates of their own type, script and format.

A surrogate is drawn from a keyed hash of the entity, so an entity has the same
one in every document without any exchange. Two entities might draw the same,
or one that really occurs; a table of the distinct entities finds such clashes
and gives the later one another attempt, until none is left. Only documents
with an entity of more than one attempt are shuffled to meet that table again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealmargin.llm import bloom
from dealmargin.llm.columns import LOWER, UPPER, enclosed, let, text_or_empty, without
from dealmargin.operators.joins import Settled, settle, spread_join

MAX_ROUNDS = 40
# From here on a surrogate gets a further character with each attempt, and an address octets
# of three digits, so that no space runs out, however many entities occur.
LOOSE_ATTEMPT = 8

# Titles by gender, and pools to draw from by script.
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа")
DIGITS = "0123456789"
CYRILLIC_LOWER = "абвгдежзиклмнопрстуфхцчшэюя"
CYRILLIC_UPPER = "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"
GREEK_LOWER = "αβγδεζηθικλμνξοπρστυφχψω"
GREEK_UPPER = "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"
HAN = "文明华强伟芳娜敏静丽军杰涛超勇艳秀霞平刚"
LATIN_SYLLABLES = (
    "ba", "de", "fi", "go", "ha", "ke", "la", "mi", "no", "pe", "ra", "so", "ta", "vi",
)
CYRILLIC_SYLLABLES = (
    "ба", "де", "фи", "го", "ха", "ке", "ла", "ми", "но", "пе", "ра", "со", "та", "ви",
)

_TITLES = "|".join(sorted(MALE_TITLES + FEMALE_TITLES, key=len, reverse=True))
_NAME = r"\p{Lu}\p{Ll}+(?![\p{L}\p{N}])"
#: Kinds in the order in which they are tried at a place, each with its pattern.
PATTERNS = {
    # Groups are bounded: one repeated very often would exhaust the stack, or be tried at every dot.
    "email": r"(?<![\p{L}\p{N}_%+-])[\p{L}\p{N}_%+-]++(?:\.[\p{L}\p{N}_%+-]++){0,20}+@"
    r"(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?\.){1,100}\p{L}{2,24}",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?"
    r"(?![A-Za-z0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{3}[\x20.-])"
    r"[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])"
    r"|(?<![0-9+])\+(?=[0-9](?:[\x20.-]?[0-9]){6})[0-9]{1,3}(?:[\x20.-]?[0-9]{2,4}){2,5}(?![0-9])",
    "name": rf"(?<![\p{{L}}])(?:{_TITLES})\.?\x20{_NAME}(?:\x20{_NAME})?",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# What every entity holds: a digit, an @ or a title.
HINT = rf"[0-9@]|(?:{_TITLES})\.?\x20\p{{Lu}}"


def _kind(match: Column) -> Column:
    kind = F.lit("name")
    for name, pattern in reversed(list(PATTERNS.items())[:-1]):
        kind = F.when(match.rlike(f"^(?:{pattern})$"), name).otherwise(kind)
    return kind


def _letters_and_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]", "")


def _title(match: Column) -> Column:
    return F.regexp_extract(match, rf"^((?:{_TITLES})\.?\x20)", 1)


def _entities(match: Column) -> Column:
    """The parts of a match that stand for someone or something, as (kind, canonical)."""

    def entity(kind: Column, canonical: Column) -> Column:
        return F.struct(kind.alias("kind"), canonical.alias("canonical"))

    def parts(kind: Column) -> Column:
        title = _title(match)
        words = F.split(F.lower(F.substring(match, F.length(title) + 1, F.length(match))), " ")
        female = F.regexp_replace(title, r"[.\x20]", "").isin(*FEMALE_TITLES)
        given = entity(F.when(female, "given_f").otherwise("given_m"), F.get(words, F.lit(0)))
        last = entity(F.lit("surname"), F.element_at(words, -1))
        domain = F.substring_index(F.lower(match), "@", -1)
        cc = F.regexp_extract(match, r"^\+([0-9]{1,3})[^0-9]", 1)
        digits = F.regexp_replace(match, "[^0-9]", "")
        phone = F.concat(cc, F.lit("+"), F.substring(digits, F.length(cc) + 1, F.length(digits)))
        return (
            F.when((kind == "name") & (F.size(words) > 1), F.array(given, last))
            .when(kind == "name", F.array(last))
            .when(
                kind == "email",
                F.array(entity(kind, F.lower(match)), entity(F.lit("domain"), domain)),
            )
            .when(kind == "ip", F.array(entity(kind, match)))
            .when(kind == "phone", F.array(entity(kind, phone)))
            .otherwise(F.array(entity(kind, _letters_and_digits(match))))
        )

    return let(_kind(match), parts)


# --- surrogates of canonical forms -------------------------------------------------


def _draw(stream: Column, at: Column) -> Column:
    """The at-th of a stream's numbers below 65536; the stream is 64 hexadecimal digits."""
    return F.conv(F.substr(stream, at * 7 % 61 + 1, F.lit(4)), 16, 10).cast("int")


def _of(pool: str, number: Column) -> Column:
    return F.substr(F.lit(pool), number % len(pool) + 1, F.lit(1))


def _same_class(char: Column, number: Column) -> Column:
    out = char
    greek, cyrillic = (GREEK_UPPER, GREEK_LOWER), (CYRILLIC_UPPER, CYRILLIC_LOWER)
    for pool in (HAN, *greek, *cyrillic, UPPER, LOWER, DIGITS):
        out = F.when(F.contains(F.lit(pool), char), _of(pool, number)).otherwise(out)
    other_latin = char.rlike(r"^[\p{IsLatin}&&[^A-Za-z]]$")
    other_han = char.rlike(r"^\p{IsHan}$")
    return (
        F.when(other_latin, _of(LOWER, number)).when(other_han, _of(HAN, number)).otherwise(out)
    )


def _mapped(text: Column, stream: Column) -> Column:
    """Every letter and digit replaced by one of its script and class, the rest as it is."""
    mapped = F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))),
            lambda i: _same_class(F.substr(text, i, F.lit(1)), _draw(stream, i)),
        ),
        "",
    )
    return F.when(text == "", "").otherwise(mapped)


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum with the last digit at an even place from the right (not doubled)."""
    return F.aggregate(
        F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: i),
        F.lit(0),
        lambda acc, i: acc
        + let(
            F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
            * F.when(i % 2 == 0, 2).otherwise(1),
            lambda d: F.when(d > 9, d - 9).otherwise(d),
        ),
    )


def _card(digits: Column, stream: Column) -> Column:
    """The first digit kept, and the check digit right if it was."""
    size = F.length(digits)
    drawn = F.concat(
        F.substr(digits, F.lit(1), F.lit(1)), _mapped(F.substr(digits, F.lit(2), size), stream)
    )
    body = F.substr(drawn, F.lit(1), size - 1)
    check = let(_luhn_sum(F.concat(body, F.lit("0"))), lambda s: (10 - s % 10) % 10)
    checked = F.concat(body, check.cast("string"))
    return F.when(_luhn_sum(digits) % 10 == 0, checked).otherwise(drawn)


def _ip(address: Column, stream: Column, attempt: Column) -> Column:
    return F.array_join(
        F.transform(
            F.split(address, r"\."),
            lambda octet, i: let(
                _draw(stream, i),
                lambda n: F.when(attempt >= 2 * LOOSE_ATTEMPT, n % 1000)
                .when(attempt >= LOOSE_ATTEMPT, n % 256)
                .when(F.length(octet) == 1, n % 10)
                .when(F.length(octet) == 2, n % 90 + 10)
                .otherwise(n % 156 + 100)
                .cast("string"),
            ),
        ),
        ".",
    )


def _syllables(pool: tuple[str, ...], stream: Column, count: Column) -> Column:
    names = F.array(*[F.lit(s) for s in pool])
    return F.array_join(
        F.transform(
            F.sequence(F.lit(1), count), lambda i: F.get(names, _draw(stream, i) % len(pool))
        ),
        "",
    )


def _named(kind: Column, name: Column, stream: Column, attempt: Column) -> Column:
    """A name of the same script: given names end as their gender's often do."""
    count = F.lit(3) + (attempt / 2).cast("int") + (F.length(name) > 8).cast("int")
    cyrillic = name.rlike(r"\p{IsCyrillic}")
    latin_end = F.when(kind == "given_f", "na").when(kind == "given_m", "rd").otherwise("ll")
    cyrillic_end = F.when(kind == "given_f", "на").when(kind == "given_m", "н").otherwise("ль")
    other = name.rlike(r"[\p{L}&&[^\p{IsLatin}\p{IsCyrillic}]]")
    longer = F.greatest(attempt - (LOOSE_ATTEMPT - 1), F.lit(0))
    more = _mapped(F.repeat(F.substr(name, F.length(name), F.lit(1)), longer), F.reverse(stream))
    return (
        F.when(other, F.concat(_mapped(name, stream), more))
        .when(cyrillic, F.concat(_syllables(CYRILLIC_SYLLABLES, stream, count), cyrillic_end))
        .otherwise(F.concat(_syllables(LATIN_SYLLABLES, stream, count), latin_end))
    )


def surrogate(kind: Column, canonical: Column, attempt: Column, key: str) -> Column:
    """The canonical form of an entity's surrogate at an attempt."""
    keyed = F.sha2(
        F.concat_ws(
            ":",
            F.lit(key),
            F.sha2(F.concat_ws(":", F.lit(key), kind, attempt.cast("string"), canonical), 256),
        ),
        256,
    )
    longer = F.greatest(attempt - (LOOSE_ATTEMPT - 1), F.lit(0))
    top = F.concat(F.lit("."), F.substring_index(canonical, ".", -1))
    low = F.length(canonical) - F.length(top)
    cc = F.substring_index(canonical, "+", 1)
    rest = F.substring_index(canonical, "+", -1)

    def of(s: Column) -> Column:
        more = _mapped(F.repeat(F.lit("0"), longer), F.reverse(s))
        return (
            F.when(
                kind == "email", F.concat(_mapped(F.substring_index(canonical, "@", 1), s), more)
            )
            .when(
                kind == "domain",
                F.concat(_mapped(F.substr(canonical, F.lit(1), low), s), more, top),
            )
            .when(kind == "ip", _ip(canonical, s, attempt))
            .when(kind == "phone", F.concat(cc, F.lit("+"), _mapped(rest, s), more))
            .when(kind == "card", F.concat(_card(canonical, s), more))
            .when(
                kind == "iban",
                F.concat(
                    F.substr(canonical, F.lit(1), F.lit(2)),
                    _mapped(F.substr(canonical, F.lit(3), F.length(canonical)), s),
                    more,
                ),
            )
            .when(kind == "ssn", F.concat(_mapped(canonical, s), more))
            .otherwise(_named(kind, canonical, s, attempt))
        )

    return let(keyed, of)


# --- putting surrogates in place ---------------------------------------------------


def _filled(shape: Column, filling: Column) -> Column:
    """The shape with its ASCII letters and digits replaced, in order, by those of the filling.

    What the filling has beyond them follows.
    """
    rest = F.substr(filling, F.length(_letters_and_digits(shape)) + 1, F.length(filling))
    filled = F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.length(shape)),
            lambda i: let(
                F.substr(shape, i, F.lit(1)),
                lambda c: F.when(
                    c.rlike("^[A-Za-z0-9]$"),
                    F.substr(
                        filling,
                        F.length(_letters_and_digits(F.substr(shape, F.lit(1), i))),
                        F.lit(1),
                    ),
                ).otherwise(c),
            ),
        ),
        "",
    )
    return F.concat(filled, rest)


def _replacement(match: Column, entities: Column, surrogates: Column) -> Column:
    kind = F.get(entities, F.lit(0))["kind"]
    first, last = F.get(surrogates, F.lit(0)), F.element_at(surrogates, -1)
    digits = F.regexp_replace(first, r"\+", "")
    names = F.array_join(F.transform(surrogates, lambda n: F.initcap(n)), " ")
    return (
        F.when(kind == "email", F.concat(first, F.lit("@"), last))
        .when(kind == "ip", first)
        .when(kind.isin("given_f", "given_m", "surname"), F.concat(_title(match), names))
        .otherwise(_filled(match, digits))
    )


def _settled_attempts(entities: DataFrame, key: str) -> Settled:
    """The entities whose first surrogate clashed, with the attempt that doesn't.

    A clash is the surrogate of another entity of the kind, or an entity of the
    kind that really occurs. Of equal surrogates the one of the earliest attempt
    and then the smallest entity stays.
    """
    real = entities.select(F.col("kind").alias("_kind"), F.col("canonical").alias("_real"))
    # An e-mail's surrogate is its local part; the domain, replaced one to one, completes it.
    domain = F.concat(F.lit("@"), F.substring_index("canonical", "@", -1))
    completed = F.when(F.col("kind") == "email", domain).otherwise("")
    trying = entities.withColumn("attempt", F.lit(0))
    for _ in range(MAX_ROUNDS):
        drawn = settle(
            trying.withColumn(
                "drawn",
                F.concat(
                    surrogate(F.col("kind"), F.col("canonical"), F.col("attempt"), key), completed
                ),
            )
        ).rows
        claims = drawn.groupBy("kind", "drawn").agg(
            F.count(F.lit(1)).alias("_n"),
            F.min(F.struct("attempt", "canonical")).alias("_first"),
        )
        beaten = (
            spread_join(drawn, claims.where(F.col("_n") > 1), ["kind", "drawn"], "inner")
            .where(F.struct("attempt", "canonical") != F.col("_first"))
            .select("kind", "canonical")
        )
        occurring = drawn.join(
            real, (F.col("kind") == F.col("_kind")) & (F.col("drawn") == F.col("_real"))
        ).select("kind", "canonical")
        clashes = settle(beaten.unionByName(occurring).distinct())
        if not clashes.count:
            break
        trying = drawn.join(
            clashes.rows.withColumn("_again", F.lit(1)), ["kind", "canonical"], "left"
        ).select(
            "kind",
            "canonical",
            (F.col("attempt") + F.coalesce("_again", F.lit(0))).alias("attempt"),
        )
    else:
        raise RuntimeError("no surrogates left that do not clash")
    return settle(drawn.where(F.col("attempt") > 0).select("kind", "canonical", "attempt"))


_ATTEMPTS = "array<struct<kind:string,canonical:string,attempt:int>>"
_NAME_KINDS = ("surname", "given_m", "given_f")


def _found(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), 0)).otherwise(
        F.array().cast("array<string>")
    )


def _with_attempts(rows: DataFrame, key: str) -> DataFrame:
    """Rows of _id, _row and _text with _attempts, their entities of more than one attempt.

    Rows that a filter of the others rules out stay where they are, so only the
    texts that hold such an entity, and a few others, are shuffled.
    """
    listed = F.explode(F.flatten(F.transform(_found(F.col("_text")), _entities))).alias("_e")
    held = settle(rows.select("_id", "_row", listed).select("_id", "_row", "_e.*").distinct()).rows
    again = _settled_attempts(settle(held.select("kind", "canonical").distinct()).rows, key)
    attempts = settle(
        spread_join(held, again.rows, ["kind", "canonical"], "inner")
        .groupBy("_id", "_row")
        .agg(F.collect_set(F.struct("kind", "canonical", "attempt")).alias("_attempts"))
        .select(F.col("_id").alias("_of"), F.col("_row").alias("_of_row"), "_attempts")
    )
    blocks = bloom.block_count(attempts.count)
    pairs = attempts.rows.select(F.xxhash64("_of", "_of_row").alias("_pair"))
    probed = bloom.with_possible(
        rows.withColumn("_pair", F.xxhash64("_id", "_row")),
        bloom.bloom_filter(pairs, "_pair", blocks),
        "_pair",
        blocks,
        "_maybe",
    )
    stay = probed.where(~F.col("_maybe")).select(
        "_own", "_text", F.lit(None).cast(_ATTEMPTS).alias("_attempts")
    )
    same = F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_row") == F.col("_of_row"))
    met = probed.where("_maybe").join(attempts.rows, same, "left")
    return stay.unionByName(met.select("_own", "_text", "_attempts"))


def _interleaved(gaps: Column, new: Column) -> Column:
    """Gaps and what stands between them, joined."""
    return F.array_join(
        F.flatten(
            F.zip_with(gaps, new, lambda gap, n: F.array(gap, F.coalesce(n, F.lit(""))))
        ),
        "",
    )


def _names_replaced(gap: Column, names: Column) -> Column:
    """The gap with mentions without a title of the document's names replaced, in one pass."""
    pattern = F.concat(
        F.lit(r"(?<!\p{L})(?:"),
        F.array_join(F.map_keys(names), "|"),
        F.lit(r")(?![\p{L}\p{N}])"),
    )
    new = F.transform(
        F.regexp_extract_all(gap, pattern, F.lit(0)), lambda m: F.element_at(names, m)
    )
    return _interleaved(F.split(gap, pattern, -1), new)


def _known_names(of: Column) -> Column:
    """From a document's entities, a map of its names to their surrogates, both capitalised."""

    def of_kind(kind: str) -> Column:
        return F.filter(of, lambda e: e["kind"] == kind)

    pairs = F.transform(
        F.concat(*map(of_kind, _NAME_KINDS)),
        lambda e: F.struct(
            F.initcap(e["canonical"]).alias("key"), F.initcap(e["surrogate"]).alias("value")
        ),
    )
    keys = F.transform(pairs, lambda p: p["key"])
    first = F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1)
    return F.map_from_entries(first)


def with_surrogates(
    docs: DataFrame, key: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Documents with every detected entity replaced, and entities, what was replaced, as
    (kind, canonical, surrogate).

    Kinds: e-mail addresses (the domain is an entity of its own), IP addresses,
    phone numbers of seven digits or more, card and other long numbers, social
    security numbers, IBANs, and names after a title. A name found so is
    replaced in the rest of its document too, with any other title or none; as
    a surname where it is one and a given name both. Equal entities get equal
    surrogates in all documents, different ones different surrogates; none is an
    entity that occurs. Digits stay digits, letters keep script and case class,
    separators, country codes, top-level domains, titles, a card's first digit
    and a right check digit stay; only where short forms run out does a
    surrogate get longer.

    NULL texts stay NULL with no entities, empty ones empty. Repeated rows are
    replaced alike and a NULL id changes nothing. A column called entities is
    replaced, others pass through, whatever their names; no rows give no rows.
    """
    docs = without(docs, "entities")
    own, whole = F.col(id_column), F.col(text_column)
    rows = enclosed(docs, _id=own, _row=F.xxhash64(whole), _text=text_or_empty(whole))

    def attempt_of(e: Column) -> Column:
        same = F.filter(
            F.col("_attempts"),
            lambda a: (a["kind"] == e["kind"]) & (a["canonical"] == e["canonical"]),
        )
        return F.coalesce(F.get(same, F.lit(0))["attempt"], F.lit(0))

    def replaced(m: Column) -> Column:
        return let(
            _entities(m),
            lambda es: let(
                F.transform(
                    es, lambda e: surrogate(e["kind"], e["canonical"], attempt_of(e), key)
                ),
                lambda ss: F.struct(
                    _replacement(m, es, ss).alias("text"),
                    F.zip_with(
                        es,
                        ss,
                        lambda e, s: F.struct(
                            e["kind"].alias("kind"),
                            e["canonical"].alias("canonical"),
                            s.alias("surrogate"),
                        ),
                    ).alias("of"),
                ),
            ),
        )

    done = _with_attempts(rows, key).withColumn(
        "_done", F.transform(_found(F.col("_text")), replaced)
    )
    listed = done.withColumn(
        "_of", F.array_distinct(F.flatten(F.transform(F.col("_done"), lambda d: d["of"])))
    ).withColumn("_names", _known_names(F.col("_of")))
    gaps = F.split(F.col("_text"), ENTITY, -1)
    named = F.when(
        F.size("_names") > 0, F.transform(gaps, lambda gap: _names_replaced(gap, F.col("_names")))
    ).otherwise(gaps)
    new = _interleaved(named, F.transform(F.col("_done"), lambda d: d["text"]))
    changed = F.when(F.size("_done") > 0, new).otherwise(F.col("_own")[text_column])
    return listed.select(
        *[changed.alias(c) if c == text_column else F.col("_own")[c].alias(c) for c in docs.columns],
        F.col("_of").alias("entities"),
    )
