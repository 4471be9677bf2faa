"""PII surrogates: keyed, type-consistent replacements that keep coreference.

Entities (e-mail addresses, IPv4 addresses, payment card numbers, social
security numbers, phone numbers, and names after a courtesy title) are found in
whole texts.  Every distinct entity of the corpus gets one surrogate, drawn by a
keyed hash: names keep gender (from the title), script and about their length,
numbers keep their length and punctuation (cards also their check sum and first
digit), addresses keep their shape and top-level domain, and e-mail addresses of
one domain share its surrogate.  So equal entities stay equal wherever they
occur, under any punctuation.  A name that a text holds after a title is replaced
at its bare mentions in that text too, as it is written there or in capitals.

Collision checks keep different entities different: a drawn surrogate that
equals a real entity of the corpus, one already given, or one drawn by another
entity in the same round is drawn again, from a wider space in later rounds,
until every entity has its own.  Given names, surnames and both genders share
one space, so no surrogate of a name is a real name of any kind.

Only SQL functions are used.  Only documents with an entity take part in
shuffles; equal texts are resolved once, so groups of copies cost one row, and
entity joins have one row per entity on one side, so Spark can split a hot one.
The patterns repeat groups possessively, so no text is long enough to recurse in.

Defined cases: a null text stays null; a text without entities is unchanged; an
empty table gives an empty result; a bare name that a text holds as two kinds
gets the surrogate of the first; input columns are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name
from .quality import bound

_MALE = r"(?:Mr\.?|Herr|Señor|Monsieur|Господин)"
_FEMALE = r"(?:Mrs\.?|Ms\.?|Frau|Señora|Madame|Госпожа)"
_NAME = r"\p{Lu}[\p{Ll}\p{M}]{1,40}"
#: Looked at first, so that the wide looks behind are tried at capitals that begin a word alone.
_CAPITAL = r"(?=\p{Lu})(?<!\p{L})"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

#: (kind, pattern), in order of precedence at one place; each becomes one capturing group.
KINDS = [
    ("email", r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)++"),
    ("ip", rf"(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.\d)"),
    ("card", r"(?<![\p{L}\p{N}])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3})(?![\p{L}\p{N}])"),
    ("ssn", r"(?<![\p{L}\p{N}\-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)"),
    ("phone", r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?![\p{L}\p{N}])"),
    ("male", rf"{_CAPITAL}(?<=(?<!\p{{L}}){_MALE} ){_NAME}(?= {_NAME})"),
    ("female", rf"{_CAPITAL}(?<=(?<!\p{{L}}){_FEMALE} ){_NAME}(?= {_NAME})"),
    ("surname", rf"{_CAPITAL}(?:(?<=(?<!\p{{L}})(?:{_MALE}|{_FEMALE}) ){_NAME}(?! {_NAME})|(?<=(?<!\p{{L}})(?:{_MALE}|{_FEMALE}) {_NAME} ){_NAME})"),
]
ENTITY = "|".join(f"({p})" for _, p in KINDS)
#: Texts that can hold a name.
NAMED = r"Mr|Ms|Herr|Frau|Señor|Monsieur|Madame|Господин|Госпожа"
#: A cheap test that every text with an entity passes.
HINT = rf"[@0-9]|{NAMED}"

#: What may be a bare mention of a name.
MENTION = r"(?<![\p{L}\p{N}])\p{Lu}(?:[\p{Ll}\p{M}]{1,40}|[\p{Lu}\p{M}]{1,40})(?![\p{L}\p{N}])"

#: Sixteen consonants and sixteen vowels of each script, and the endings of each kind of name.  Fixed values.
SOUNDS = {
    "Latin": ("bcdfghjklmnprstv", "aeioaeiuaeioaeiu", {"male": "n", "female": "na", "surname": "r"}),
    "Cyrillic": ("бвгджзклмнпрстфх", "аеиоаеиуаеиоаеиу", {"male": "н", "female": "на", "surname": "ков"}),
    "Greek": ("βγδζθκλμνξπρστφχ", "αειοαειοαειοαειο", {"male": "νος", "female": "να", "surname": "ρης"}),
}
NAME_KINDS = ("male", "female", "surname")
LETTERS = {"Latin": "abcdefghijklmnop", "Cyrillic": "абвгдежзиклмнопр", "Greek": "αβγδεζηθικλμνξοπ"}


def _digits(raw: Column) -> Column:
    return F.regexp_replace(raw, r"[^0-9]", "")


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum of a digit string; ``doubled``: 1 to double every second digit counted from the last but one, 0 from the last."""

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == doubled, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(F.transform(chars, value), F.lit(0), lambda a, b: a + b)


def script_of(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "Cyrillic").when(text.rlike(r"\p{IsGreek}"), "Greek").otherwise("Latin")


def entities(text: Column) -> Column:
    """Array of (kind, raw, canon) of every match of ``ENTITY``, in order; canon is null where the match is no entity after all."""
    raws = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    none = F.array().cast("array<string>")
    # which kind of name a match is depends on the words before it, so it is read from the groups, where there are names
    of = {k: F.when(text.rlike(NAMED), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(i + 1))).otherwise(none) for i, (k, _) in enumerate(KINDS) if k in ("male", "female")}
    matches = F.arrays_zip(raws.alias("raw"), of["male"].alias("male"), of["female"].alias("female"))

    def one(m: Column) -> Column:
        raw = m["raw"]
        kind = (
            F.when(raw.contains("@"), "email")
            .when(raw.rlike(r"^\p{L}"), F.when(m["male"] != "", "male").when(m["female"] != "", "female").otherwise("surname"))
            .otherwise(F.coalesce(*[F.when(raw.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in KINDS[1:5]]))
        )
        digits = _digits(raw)
        canon = (
            F.when(kind == "email", F.lower(raw))
            .when(kind == "ip", raw)
            .when(kind == "card", F.when(luhn_sum(digits, 1) % 10 == 0, digits))
            .when(kind == "phone", F.concat(F.when(raw.startswith("+"), "+").otherwise(""), digits))
            .when(kind == "ssn", digits)
            .otherwise(F.lower(raw))
        )
        return F.struct(kind.alias("kind"), raw.alias("raw"), canon.alias("canon"))

    return F.transform(matches, one)


def space_of(kind: Column) -> Column:
    """Kinds of one space never share a surrogate."""
    return F.when(kind.isin(*NAME_KINDS), "name").otherwise(kind)


def keyed_hash(kind: Column, canon: Column, turn: int, key: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, F.lit(str(turn))), 256)


def draw(kind: Column, canon: Column, host: Column, mark: Column, more: Column, turn: int) -> Column:
    """The keyed surrogate (canonical form) of an entity in round ``turn``; later rounds draw from wider spaces.

    ``host``: the surrogate of an e-mail address's domain; ``mark``, ``more``: two keyed hashes in hexadecimal.
    """

    def number(k: int) -> Column:  # 9 decimal digits from 15 hex digits
        part = F.substring(F.concat(mark, more), 1 + 15 * k, 15)
        return F.lpad((F.conv(part, 16, 10).cast("decimal(20,0)") % 1_000_000_000).cast("int").cast("string"), 9, "0")

    random_digits = F.concat(*[number(k) for k in range(4)])
    extra = max(0, turn - 3)
    plain = canon.substr(F.lit(1), F.lit(1))
    n = F.length(canon) + extra
    # a phone keeps its plus and first digit; the next digit is none of 0 and 1, which no area code begins with
    lead = F.translate(F.substring(random_digits, 1, 1), "01", "23")
    tail = F.substring(random_digits, 2, 35)
    phone = F.when(plain == "+", F.concat(F.substring(canon, 1, 2), lead, tail.substr(F.lit(1), n - 3))).otherwise(F.concat(lead, tail.substr(F.lit(1), n - 1)))
    body = F.concat(plain, random_digits.substr(F.lit(1), n - 2))
    card = F.concat(body, F.pmod(-luhn_sum(body, 0), F.lit(10)).cast("string"))
    octet = lambda k: (F.conv(F.substring(mark, 1 + 4 * k, 4), 16, 10).cast("int") % 254 + 1).cast("string")
    ip = F.concat_ws(".", *[octet(k) for k in range(4)]) if turn < 8 else F.concat(F.lit("2001:db8::"), F.substring(mark, 1, 4 + turn))

    script = script_of(canon)
    letters = F.coalesce(*[F.when(script == s, F.translate(F.concat(mark, more), "0123456789abcdef", a)) for s, a in LETTERS.items()])
    at = lambda s, i: s.substr(i % 64 + 1, F.lit(1))

    def shaped(x: Column) -> Column:
        one = lambda c, i: F.when(c.rlike(r"^\p{L}$"), at(x["letters"], i)).when(c.rlike(r"^\p{N}$"), at(x["digits"], i % 36)).otherwise(c)
        return F.array_join(F.transform(x["chars"], one), "")

    local = F.substring_index(canon, "@", 1)
    chars = F.filter(F.split(F.rpad(local, F.greatest(F.length(local), F.lit(6 + turn)).cast("int"), "x"), ""), lambda c: c != "")
    email = F.concat(bound(F.struct(letters.alias("letters"), random_digits.alias("digits"), chars.alias("chars")), shaped), F.lit("@"), host)

    def syllables(script: str, count: Column) -> Column:
        consonants, vowels, _ = SOUNDS[script]
        sounds = lambda marks, alphabet: F.translate(marks, "0123456789abcdef", alphabet)
        both = F.struct(sounds(mark, consonants).alias("c"), sounds(more, vowels).alias("v"))
        return bound(both, lambda x: F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.concat(at(x["c"], i), at(x["v"], i))), ""))

    def name() -> Column:
        picks = []
        for s, (_, _, endings) in SOUNDS.items():
            for k, ending in endings.items():
                # a syllable more in each round: its space is some hundred times larger
                count = F.greatest(F.lit(2), ((F.length(canon) - len(ending) + 1) / 2).cast("int")) + turn
                end = F.when(canon.endswith("а"), "кова").otherwise("ков") if (k, s) == ("surname", "Cyrillic") else F.lit(ending)
                picks.append(F.when((kind == k) & (script == s), F.concat(F.initcap(syllables(s, count)), end)))
        return F.coalesce(*picks)

    return (
        F.when(kind == "domain", F.concat(syllables("Latin", F.lit(4 + turn)), F.lit(".example."), F.substring_index(canon, ".", -1)))
        .when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "card", card)
        .when(kind == "phone", phone)
        .when(kind == "ssn", random_digits.substr(F.lit(1), n))
        .otherwise(name())
    )


def assign(found: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) of every distinct (kind, canon, host) in ``found``, all surrogates distinct and none a real entity."""
    real = cut(found.select("kind", "canon", "host").distinct())
    pending, given, turn = real, [], 0
    space = space_of(F.col("kind")).alias("space")
    folded = real.select(space, F.lower("canon").alias("form"))
    while True:
        hashed = pending.withColumn("mark", keyed_hash(F.col("kind"), F.col("canon"), turn, key)).withColumn("more", F.sha2(F.concat(F.lit(key), "mark"), 256))
        drawn = hashed.withColumn("surrogate", draw(*[F.col(c) for c in ("kind", "canon", "host", "mark", "more")], turn)).drop("mark", "more")
        drawn = drawn.withColumns({"form": F.lower("surrogate"), "space": space})
        free = drawn.join(folded, ["space", "form"], "left_anti")
        for old in given:
            free = free.join(old.select("space", "form"), ["space", "form"], "left_anti")
        won = free.groupBy("space", "form").agg(F.min(F.struct("kind", "canon", "surrogate")).alias("w"))
        won = cut(won.select("space", "form", "w.kind", "w.canon", "w.surrogate"))
        given.append(won)
        pending = cut(pending.join(won, ["kind", "canon"], "left_anti"))
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, given).select("kind", "canon", "surrogate")
        turn += 1


def render(kind: Column, raw: Column, surrogate: Column) -> Column:
    """``surrogate`` in the punctuation of ``raw``."""

    def fill(digits: Column) -> Column:
        def put(acc: Column, c: Column) -> Column:
            digit = c.rlike("^[0-9]$")
            return F.struct(
                F.concat(acc["text"], F.when(digit, digits.substr(acc["next"], F.lit(1))).otherwise(c)).alias("text"),
                (acc["next"] + digit.cast("int")).alias("next"),
            )

        chars = F.filter(F.split(raw, ""), lambda c: c != "")
        # digits that a later round added go to the end
        return F.aggregate(chars, F.struct(F.lit("").alias("text"), F.lit(1).alias("next")), put, lambda acc: F.concat(acc["text"], digits.substr(acc["next"], F.lit(40))))

    return F.when(kind.isin("card", "phone", "ssn"), bound(_digits(surrogate), fill)).otherwise(surrogate)


def with_mentions(part: Column, names: Column) -> Column:
    """``part`` with every bare mention of one of ``names``, (lowered name, surrogate), replaced."""

    def one(word: Column) -> Column:
        place = F.array_position(F.transform(names, lambda x: x["canon"]), F.lower(word))
        return F.when(place > 0, bound(F.get(names, (place - 1).cast("int"))["shown"], lambda x: F.when(word == F.upper(word), F.upper(x)).otherwise(x))).otherwise(word)

    words = F.transform(F.regexp_extract_all(part, F.lit(MENTION), F.lit(0)), one)
    return F.array_join(F.zip_with(F.split(part, MENTION, -1), words, lambda gap, w: F.concat(gap, F.coalesce(w, F.lit("")))), "")


def replace_pii(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with replaced texts and a column ``pii`` more: array of (kind, surrogate) in order of place.

    ``key`` is the secret that surrogates depend on.  Bare mentions are replaced but not listed.
    """
    out, mark, tag = free_name(docs, "pii"), free_name(docs, "text_key"), free_name(docs, "given")
    text = F.col(f"`{text_col}`")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hit = F.coalesce(text.rlike(HINT) & text.rlike(ENTITY), F.lit(False))
    empty = F.array().cast("array<struct<kind:string,surrogate:string>>")
    rest = docs.where(~hit).select(*columns, empty.alias(out))
    hits = docs.where(hit).withColumn(mark, F.concat_ws(":", F.xxhash64(text), F.xxhash64(text, F.lit(1)), F.length(text)))

    matches = hits.groupBy(mark).agg(F.first(text).alias("text")).select(mark, F.posexplode(entities(F.col("text"))).alias("pos", "e")).select(mark, "pos", "e.*")
    matches = cut(matches)
    real = matches.where(F.col("canon").isNotNull())
    domain = F.when(F.col("kind") == "email", F.substring_index("canon", "@", -1)).alias("domain")
    hosts = assign(real.where(F.col("kind") == "email").select(F.lit("domain").alias("kind"), domain.alias("canon"), F.lit(None).cast("string").alias("host")), key)
    hosts = hosts.select(F.col("canon").alias("domain"), F.col("surrogate").alias("host"))
    given = assign(real.select("kind", "canon", domain).distinct().join(hosts, "domain", "left"), key)
    named = matches.join(given, ["kind", "canon"], "left")
    shown = F.coalesce(render(F.col("kind"), F.col("raw"), F.col("surrogate")), F.col("raw"))
    lists = named.groupBy(mark).agg(F.array_sort(F.collect_list(F.struct("pos", shown.alias("shown"), F.col("surrogate").isNotNull().alias("real"), "kind", "canon"))).alias(tag))

    joined = hits.join(lists, mark)
    names = F.array_distinct(F.transform(F.filter(F.col(tag), lambda g: g["real"] & g["kind"].isin(*NAME_KINDS)), lambda g: F.struct(g["canon"], g["shown"])))

    def rebuilt(ns: Column) -> Column:
        parts = F.split(text, ENTITY, -1)
        parts = F.when(F.size(ns) > 0, F.transform(parts, lambda p: with_mentions(p, ns))).otherwise(parts)
        return F.array_join(F.zip_with(parts, F.col(tag), lambda part, g: F.concat(part, F.coalesce(g["shown"], F.lit("")))), "")

    given_list = F.transform(F.filter(F.col(tag), lambda g: g["real"]), lambda g: F.struct(g["kind"].alias("kind"), g["shown"].alias("surrogate")))
    changed = joined.select(*[bound(names, rebuilt).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], given_list.alias(out))
    return rest.unionByName(changed)
