"""Surrogates for personal data, in DataFrame operations only.

Detected entities get keyed replacements of the same type, format, script and gender: every digit and
letter is drawn anew within its own class from a digest of key, type and entity; separators stay. Rules
per type keep a replacement valid (check digits, reserved addresses and domains, names of the gender
that the title tells). What an entity is does not depend on separators or the case of an address, so
two spellings of one number get the same digits (coreference). A table of all distinct entities is
checked: where two would meet, or one would meet a real entity, they are drawn again (distinctness).
A format that is too full for that (real entities fill it, or all of 10.0.0.0/8) does not settle by drawing;
after ROUNDS rounds all its entities are replaced by a keyed permutation of the format's own space. That
keeps them distinct whatever their number, and never leaves one as it was, but a surrogate may then be
another real entity of the format: with the space full there is no other.
Names are found by their titles; every other mention of a found name in its document is replaced too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import BROADCAST_ROWS, small_side
from colloquy.session import discard, materialize

#: Rounds of drawing anew; each round settles most of a format that has room.
ROUNDS = 10
#: Draw number of entities whose format is permuted instead.
PERMUTED = -1
#: Steps of the permutation, and as many back.
_STEPS = 6
#: Country codes of E.164: zones 1 and 7, codes of two digits, others of three; separators may stand between digits.
_GAP = r"[ .()\-]{0,2}"
_COUNTRY = "(?:[17]|" + "|".join(f"{zone}{_GAP}{second}" for zone, second in [
    ("2", "[07]"), ("3", "[0-469]"), ("4", "[013-9]"), ("5", "[1-8]"), ("6", "[0-6]"), ("8", "[1246]"), ("9", "[0-58]"),
]) + f"|[0-9]{_GAP}[0-9]{_GAP}[0-9])"

FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа"
MALE = "Mr|Herr|Monsieur|Señor|Sr|Господин"
#: Key words that announce a secret, up to the secret itself.
KEY_WORD = r"(?i:password|passwd|pwd|secret|api[_\-]?key|access[_\-]?key|token)[ ]{0,2}"
LEAD = rf"{KEY_WORD}[=:][ ]{{0,2}}[\"']?"
_VALUE = r"[^\s\"',;|<>]"
#: A secret without digits has four letters and no bracket, and = or a quote before it, or is all that follows "password:".
_WORDY = rf"(?!{_VALUE}*[(\[{{$])(?=(?:[^\p{{L}}\s\"',;|<>]*+\p{{L}}){{4}}){_VALUE}{{6,}}+"
_CLEAR = (
    rf"{KEY_WORD}(?:=[ ]{{0,2}}[\"']?|:[ ]{{0,2}}[\"']){_WORDY}"
    rf"|(?i:password|passwd|pwd)[ ]{{0,2}}:[ ]{{0,2}}{_WORDY}(?=[ \t]*(?:[\r\n,;|]|\z))"
)
#: A word of a name: inner hyphens and apostrophes belong to it, a possessive 's does not.
_NAME = r"\p{Lu}(?=\p{L}|['’]\p{L}{2}|-\p{L})\p{L}*+(?:(?:['’](?=\p{L}{2})|-)\p{L}++)*+"

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Where two could match at one place the first wins. Cuts of a longer run of digits never match.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]*[A-Za-z0-9])+",
    "ip": rf"(?<![0-9A-Za-z.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9A-Za-z]|\.[0-9])",
    "assigned": rf"(?<![0-9A-Za-z])(?:{LEAD}(?={_VALUE}*[0-9]){_VALUE}{{6,}}|{_CLEAR})",
    "secret": r"(?<![0-9A-Za-z])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|(?:sk|pk|ghp|gho|xoxb|xoxp)[_\-][0-9A-Za-z_\-]{16,})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z\-])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}[ \-](?:[0-9]{4}[ \-][0-9]{4}[ \-][0-9]{1,7}|[0-9]{6}[ \-][0-9]{5})|[0-9]{13,19})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}"
             r"|\([0-9]{2,4}\)[ .\-]?[0-9]{3,4}[ .\-][0-9]{3,4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})(?![0-9A-Za-z])",
    "name": rf"(?<!\p{{L}})(?:{FEMALE}|{MALE})\.? {_NAME}(?: {_NAME})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these holds no entity; this one cheap test passes over most texts.
HINT = rf"[0-9@]|AKIA|ASIA|(?:sk|pk|ghp|gho|xoxb|xoxp)[_\-]|(?:{FEMALE}|{MALE})\.? |{KEY_WORD}[=:]"

GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Hugo Ivan Jonas Leo Marco Nils Oscar Paul Simon Victor".split(),
    ("latin", "f"): "Alice Bella Clara Diana Elena Flora Hanna Irene Julia Laura Maria Nora Olga Paula Sofia Vera".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Денис Игорь Лев Максим Олег".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo".split(),
    "cyrillic": "ба бе бо да де до га го ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то ва ве во".split(),
}
_LATIN, _CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя"
_IS_CYRILLIC = r"[Ѐ-ӿ]"


def kind_of(entity: Column) -> Column:
    """Type of a matched string, told by its form alone."""
    forms = [
        ("name", rf"^(?:{FEMALE}|{MALE})\.? "), ("assigned", f"^{LEAD}"), ("email", "@"),
        ("ip", r"^[0-9]+(?:\.[0-9]+){3}$"), ("ssn", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"),
        ("iban", PATTERNS["iban"]), ("card", r"^[0-9 \-]{13,}$"), ("phone", r"^[+(0-9][0-9() .\-]+$"),
    ]
    return reduce(lambda rest, f: F.when(entity.rlike(f[1]), F.lit(f[0])).otherwise(rest), reversed(forms), F.lit("secret"))


def _lead(kind: Column, entity: Column) -> Column:
    """What stays in front of the part that is drawn anew."""
    return (
        F.when(kind == "assigned", F.regexp_extract(entity, f"^{LEAD}", 0))
        .when(kind == "phone", F.regexp_extract(entity, rf"^\+{_COUNTRY}", 0))
        .when(kind == "iban", F.substring(entity, 1, 2)).otherwise(F.lit(""))
    )


def _rest(entity: Column, lead: Column) -> Column:
    return F.substring(entity, F.length(lead) + 1, F.length(entity))


def identity(kind: Column, entity: Column) -> Column:
    """The same for all spellings of an entity: no separators, no case where case means nothing."""
    return (
        F.when(kind == "email", F.lower(entity))
        .when(kind.isin("card", "phone", "ssn", "iban"), F.regexp_replace(entity, "[^0-9A-Z+]", ""))
        .when(kind == "assigned", _rest(entity, _lead(kind, entity)))
        .otherwise(entity)
    )


def _described(entity: Column, people: Column | None = None) -> Column:
    """A match with what its form tells: entity, kind, identity, lead, and the parts of a name.

    `people` are the names of the text (see `people_of`); a match that is one of their words is a mention.
    """
    def mention(e: Column, of: str) -> Column:
        return F.lit(False) if people is None else F.array_contains(people[of], e)

    def kinds(e: Column) -> Column:
        kind = kind_of(e)
        return F.struct(e.alias("entity"), F.when(mention(e, "words"), "name").otherwise(kind).alias("kind"))

    def details(s: Column) -> Column:
        e, words = s["entity"], F.split(s["entity"], " ")
        titled = (s["kind"] == "name") & (F.size(words) > 1)
        bare = (s["kind"] == "name") & (F.size(words) == 1)
        kind = F.when(e.rlike(rf"^(?:{FEMALE})\.? "), F.lit("given_f")).otherwise(F.lit("given_m"))
        if people is not None:
            kind = F.when(
                bare, F.try_element_at(F.filter(people["given"], lambda g: g["word"] == e), F.lit(1))["kind"]
            ).otherwise(kind)
        return F.struct(
            e.alias("entity"), s["kind"].alias("kind"), identity(s["kind"], e).alias("identity"),
            _lead(s["kind"], e).alias("lead"), F.when(titled, F.element_at(words, 1)).alias("title"),
            F.when(titled & (F.size(words) > 2), F.element_at(words, 2)).when(bare & ~mention(e, "family"), e)
            .otherwise(F.lit("")).alias("given"),
            F.when(titled, F.element_at(words, -1)).when(bare & mention(e, "family"), e).otherwise(F.lit("")).alias("family"),
            kind.alias("given_kind"),
        )

    # Lambda variables hold each step, so that no expression is written out for every use.
    return F.transform(F.transform(entity, kinds), details)


def people_of(titled: Column) -> Column:
    """The names among described matches: family and given names (word, kind), and all their words, longest first."""
    named = F.filter(titled, lambda s: s["kind"] == "name")
    family = F.array_distinct(F.transform(named, lambda s: s["family"]))
    given = F.array_distinct(F.transform(
        F.filter(named, lambda s: s["given"] != ""), lambda s: F.struct(s["given"].alias("word"), s["given_kind"].alias("kind"))
    ))
    every = F.array_union(family, F.transform(given, lambda g: g["word"]))
    ordered = F.array_sort(F.transform(every, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("word"))))
    return F.struct(family.alias("family"), given.alias("given"), F.transform(ordered, lambda w: w["word"]).alias("words"))


def pattern_of(people: Column) -> Column:
    """What to replace in a text with these people: entities, and mentions of the names as whole words."""
    # Names have letters, hyphens and apostrophes only, so nothing is to be quoted.
    mentions = F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(people["words"], "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return F.when(F.size(people["words"]) > 0, mentions).otherwise(F.lit(ANY))


def parts_of(s: Column) -> Column:
    """The things of a described match that need a surrogate each: array of (kind, identity)."""
    def part(kind: Column, ident: Column) -> Column:
        return F.struct(kind.alias("kind"), ident.alias("identity"))

    whole = part(s["kind"], s["identity"])
    given, family = part(s["given_kind"], F.lower(s["given"])), part(F.lit("family"), F.lower(s["family"]))
    return F.when(s["kind"] != "name", F.array(whole)).when(s["given"] == "", F.array(family)).otherwise(F.array(given, family))


def _seed(kind: Column, ident: Column, key: str, draw: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(key), kind, ident, draw.cast("string")), 256)


def _draw(seed: Column, place: Column, most: int) -> Column:
    return F.pmod(F.xxhash64(seed, place), F.lit(most)).cast("int")


def _letter(seed: Column, place: Column, alphabet: str) -> Column:
    return F.substring(F.lit(alphabet), _draw(seed, place, len(alphabet)) + 1, F.lit(1))


def _redrawn(text: Column, seed: Column) -> Column:
    """Digits and letters drawn anew within their class; the k-th of them depends on seed and k only.

    A hexadecimal string stays one: its letters are drawn from a to f.
    """
    hexed = text.rlike("^[0-9A-Fa-f]{16,}$")

    def step(state: Column, c: Column) -> Column:
        k = state["k"]
        lower = (
            F.when(c.rlike(_IS_CYRILLIC), _letter(seed, k, _CYRILLIC))
            .when(hexed, _letter(seed, k, "abcdef")).otherwise(_letter(seed, k, _LATIN))
        )
        drawn = (
            F.when(c.rlike("[0-9]"), _draw(seed, k, 10).cast("string"))
            .when(c.rlike(r"\p{Lu}"), F.upper(lower)).when(c.rlike(r"\p{L}"), lower)
        )
        return F.struct(
            F.concat(state["out"], F.coalesce(drawn, c)).alias("out"),
            F.when(drawn.isNull(), k).otherwise(k + 1).alias("k"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))
    return F.aggregate(F.split(text, ""), start, step, lambda state: state["out"])


def _luhn(digits: Column) -> Column:
    each = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
        ),
    )
    return F.aggregate(each, F.lit(0), lambda total, d: total + d)


def _card(entity: Column, drawn: Column) -> Column:
    """A valid number gets the check digit that makes its surrogate valid; others stay as drawn."""
    only = F.regexp_replace(drawn, "[^0-9]", "")
    open_end = F.concat(F.substring(only, F.lit(1), F.length(only) - 1), F.lit("0"))
    check = F.pmod(F.lit(10) - _luhn(open_end) % 10, F.lit(10)).cast("string")
    valid = _luhn(F.regexp_replace(entity, "[^0-9]", "")) % 10 == 0
    return F.when(valid, F.concat(F.substring(drawn, F.lit(1), F.length(drawn) - 1), check)).otherwise(drawn)


def _spoken(seed: Column, script: str, count: Column) -> Column:
    """A pronounceable name of `count` syllables."""
    table = F.array(*[F.lit(s) for s in SYLLABLES[script]])
    return F.array_join(
        F.transform(F.sequence(F.lit(1), count), lambda i: F.element_at(table, _draw(seed, i, len(SYLLABLES[script])) + 1)), ""
    )


def _person(kind: Column, word: Column, seed: Column, draw: Column) -> Column:
    """A given name of the gender or a family name, of the word's script; longer with every redraw."""
    def listed(script: str, gender: str) -> Column:
        names = GIVEN[script, gender]
        table = F.array(*[F.lit(n) for n in names])
        picks = F.transform(F.sequence(F.lit(0), draw), lambda i: F.element_at(table, _draw(seed, i, len(names)) + 1))
        return F.array_join(picks, "-")

    def of(script: str) -> Column:
        family = F.initcap(_spoken(seed, script, draw + 3))
        return F.when(kind == "given_f", listed(script, "f")).when(kind == "given_m", listed(script, "m")).otherwise(family)

    return F.when(word.rlike(_IS_CYRILLIC), of("cyrillic")).otherwise(of("latin"))


def _permutation(values: Column, radices: Column, seed: Column) -> Column:
    """Numbers below their radices, permuted without a fixed point: there, one on in the first number, and back.

    Each step adds to every second number what a digest of the others says, so it can be taken back.
    """
    def step(state: Column, j: Column) -> Column:
        back = j >= _STEPS
        half = F.when(back, 2 * _STEPS - 1 - j).otherwise(j) % 2
        moved = F.transform(state, lambda v, i: F.when(
            (j == _STEPS) & (i == 0), (v + 1) % F.element_at(radices, 1)
        ).otherwise(v))

        def turned(values: Column) -> Column:
            others = F.array_join(F.filter(values, lambda _, i: i % 2 != half), ",")
            return _bound(others, lambda o: F.transform(values, lambda v, i: F.when(
                i % 2 == half,
                F.pmod(v + F.when(back, -1).otherwise(1) * _draw(F.concat_ws(",", seed, o, F.when(back, 2 * _STEPS - 1 - j).otherwise(j).cast("string")), i, 1 << 20),
                       F.element_at(radices, i + 1)),
            ).otherwise(v)))

        return _bound(moved, turned)

    return F.aggregate(F.sequence(F.lit(0), F.lit(2 * _STEPS - 1)), values, step)


def _permuted(text: Column, seed: Column) -> Column:
    """Digits and letters of a text permuted within their classes; case, separators and other letters stay."""
    hexed = text.rlike("^[0-9A-Fa-f]{16,}$")

    def of(c: Column) -> Column:
        low = F.lower(c)
        cyrillic = F.instr(F.lit(_CYRILLIC), low) - 1
        value = F.when(c.rlike("^[0-9]$"), c.cast("int")).when(c.rlike("^[A-Za-z]$"), F.ascii(low) - 97).otherwise(cyrillic)
        radix = (
            F.when(c.rlike("^[0-9]$"), 10).when(c.rlike("^[A-Za-z]$"), F.when(hexed, 6).otherwise(26))
            .when(cyrillic >= 0, len(_CYRILLIC)).otherwise(0)
        )
        return F.struct(c.alias("c"), value.cast("int").alias("value"), radix.cast("int").alias("radix"))

    def written(c: Column, value: Column) -> Column:
        letter = F.when(c["radix"] == len(_CYRILLIC), F.substring(F.lit(_CYRILLIC), value + 1, F.lit(1))).otherwise(F.char(value + 97))
        cased = F.when(c["c"] == F.lower(c["c"]), letter).otherwise(F.upper(letter))
        return F.when(c["radix"] == 10, value.cast("string")).otherwise(cased)

    def rebuilt(parts: Column) -> Column:
        open_ = F.filter(parts, lambda p: p["radix"] > 0)
        new = _bound(F.transform(open_, lambda p: p["radix"]), lambda radices: _permutation(
            F.transform(open_, lambda p: p["value"]), radices, seed
        ))
        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

        def put(state: Column, p: Column, values: Column) -> Column:
            drawn = p["radix"] > 0
            return F.struct(
                F.concat(state["out"], F.when(drawn, written(p, F.try_element_at(values, state["k"] + 1))).otherwise(p["c"])).alias("out"),
                F.when(drawn, state["k"] + 1).otherwise(state["k"]).alias("k"),
            )

        return _bound(new, lambda values: F.aggregate(parts, start, lambda state, p: put(state, p, values), lambda state: state["out"]))

    return _bound(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), of), rebuilt)


def _permuted_plain(kind: Column, entity: Column, lead: Column, key: str) -> Column:
    """Surrogate of everything but names by the permutation of its format; the same for every entity of a kind."""
    seed = F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit("permutation"), kind), 256)
    octets = F.transform(F.split(entity, r"\."), lambda o: o.cast("int"))
    address = F.array_join(_permutation(octets, F.array_repeat(F.lit(256), 4), seed), ".")
    body = F.substring(entity, F.lit(1), F.length(entity) - 1)

    def card(new: Column) -> Column:
        # The distance of the last digit from the check digit stays, so valid numbers stay valid.
        def check(digits: Column) -> Column:
            return F.pmod(F.lit(10) - _luhn(F.concat(F.regexp_replace(digits, "[^0-9]", ""), F.lit("0"))) % 10, F.lit(10))

        return F.concat(new, F.pmod(F.right(entity, F.lit(1)).cast("int") - check(body) + check(new), F.lit(10)).cast("string"))

    return (
        F.when(kind == "email", F.concat(_permuted(entity, seed), F.lit(".example.org")))
        .when(kind == "ip", address).when(kind == "card", _bound(_permuted(body, seed), card))
        .otherwise(F.concat(lead, _permuted(_rest(entity, lead), seed)))
    )


def _plain(kind: Column, entity: Column, lead: Column, key: str, seed: Column, draw: Column) -> Column:
    """Surrogate of everything but names."""
    def host(e: Column) -> Column:
        named = F.lower(F.substring(e, F.instr(e, "@") + 1, F.length(e)))
        return F.concat(_spoken(F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit("host"), named), 256), "latin", F.lit(4)), F.lit(".example.org"))

    email = F.concat(_redrawn(F.substring(entity, F.lit(1), F.instr(entity, "@") - 1), seed), F.lit("@"), host(entity))
    address = F.concat_ws(".", F.lit("10"), *[_draw(seed, F.lit(i), 256).cast("string") for i in range(3)])
    drawn = _bound(F.concat(lead, _redrawn(_rest(entity, lead), seed)), lambda d: (
        F.when(kind == "card", _card(entity, d))
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(d, F.lit(2), F.length(d)))).otherwise(d)
    ))
    return (
        F.when(draw == PERMUTED, _permuted_plain(kind, entity, lead, key))
        .when(kind == "email", email).when(kind == "ip", address).otherwise(drawn)
    )


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def surrogate_of(s: Column, draws: Column, key: str) -> Column:
    """The replacement of a described match; `draws` maps kind and identity to a draw number above 0."""
    def drawn(kind: Column, ident: Column, use) -> Column:
        number = F.coalesce(F.try_element_at(draws, F.concat_ws("\u0001", kind, ident)), F.lit(0))
        return _bound(number, lambda n: _bound(_seed(kind, ident, key, n), lambda seed: use(seed, n)))

    def person(kind: Column, word: Column) -> Column:
        return drawn(kind, F.lower(word), lambda seed, n: _person(kind, word, seed, n))

    name = F.concat_ws(
        " ", s["title"], F.when(s["given"] != "", person(s["given_kind"], s["given"])),
        F.when(s["family"] != "", person(F.lit("family"), s["family"])),
    )
    plain = drawn(s["kind"], s["identity"], lambda seed, n: _plain(s["kind"], s["entity"], s["lead"], key, seed, n))
    return F.when(s["kind"] == "name", name).otherwise(plain)


def _shown(kind: Column, ident: Column, key: str, draw: Column) -> Column:
    """The identity of an entity's surrogate, by which surrogates are compared."""
    named = kind.isin("family", "given_m", "given_f")
    # The lead of an assignment is no part of its identity.
    spelled = F.when(kind == "assigned", F.concat(F.lit("key="), ident)).otherwise(ident)

    def of(seed: Column) -> Column:
        return F.when(named, F.lower(_person(kind, ident, seed, draw))).otherwise(
            _bound(spelled, lambda e: _bound(_plain(kind, e, _lead(kind, e), key, seed, draw), lambda p: identity(kind, p)))
        )

    return _bound(_seed(kind, ident, key, draw), of)


def matches(text: Column) -> Column:
    """All entities of a text, described, in order; names by their titles only."""
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return _described(found)


def _format(kind: Column, ident: Column) -> Column:
    """What a permutation keeps of an entity: entities of different formats stay different."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(ident, "[0-9]", "0"), r"\p{Lu}", "A"), r"\p{L}", "a")
    return F.when(kind.isin("email", "ip", "ssn", "card"), F.lit("")).when(
        kind.isin("phone", "iban"), F.concat(_lead(kind, ident), F.lit(" "), shape)
    ).otherwise(F.concat(shape, F.when(ident.rlike("^[0-9A-Fa-f]{16,}$"), "h").otherwise("")))


def redraws(found: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """Draw numbers other than 0: (kind, identity, draw), for entities whose surrogates met others.

    Each round draws again for all but the smallest of those that meet, and for those that meet a real
    entity; it works on the entities that still move. Names, which grow with every draw, go on until nothing
    meets; formats in which anything still meets after `rounds` rounds are PERMUTED as a whole.
    """
    named = F.col("kind").isin("family", "given_m", "given_f")
    settled = materialize(found.select("kind", "identity").distinct().withColumn("draw", F.lit(0)))
    real = settled.select("kind", F.col("identity").alias("shown"))
    state = materialize(settled.withColumn("shown", _shown(F.col("kind"), F.col("identity"), key, F.col("draw"))))
    done = 0
    while True:
        holders = state.groupBy("kind", "shown").agg(
            F.min(F.struct("draw", "identity")).alias("first"), F.max("draw").alias("last"), F.count(F.lit(1)).alias("n")
        )
        # What is permuted stays: it is distinct already, and may be real.
        met = holders.where(F.col("last") != PERMUTED).join(real.withColumn("is_real", F.lit(True)), ["kind", "shown"], "left")
        moving = small_side(
            met.where("n > 1 or is_real").select("kind", "shown", "first", F.coalesce("is_real", F.lit(False)).alias("is_real"))
        )
        if moving.isEmpty():
            discard(moving)
            return state.where("draw <> 0").select("kind", "identity", "draw")
        again = F.col("first").isNotNull() & (F.col("draw") != PERMUTED) & (
            F.col("is_real") | (F.struct("draw", "identity") != F.col("first"))
        )
        moved = state.join(moving, ["kind", "shown"], "left").withColumn("again", again)
        if done < rounds:
            draw = F.when(F.col("again"), F.col("draw") + 1).otherwise(F.col("draw"))
        else:
            full = small_side(
                moved.where("again").where(~named).select("kind", _format(F.col("kind"), F.col("identity")).alias("format"))
                .distinct().withColumn("full", F.lit(True))
            )
            moved = moved.withColumn("format", _format(F.col("kind"), F.col("identity"))).join(full, ["kind", "format"], "left")
            draw = F.when(F.col("full"), PERMUTED).when(F.col("again"), F.col("draw") + 1).otherwise(F.col("draw"))
        before, moved = state, moved.withColumn("next", draw)
        shown = F.when(F.col("next") != F.col("draw"), _shown(F.col("kind"), F.col("identity"), key, F.col("next")))
        state = materialize(moved.select("kind", "identity", F.col("next").alias("draw"), F.coalesce(shown, "shown").alias("shown")))
        discard(before, moving)
        done += 1


def replace_entities(docs: DataFrame, key: str = "surrogates", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """The documents with surrogates in place of entities, all columns kept, and `n_entities` added.

    Null texts stay null (0 entities); texts without entities stay as they are to the byte.
    A word of a name that stands with a title anywhere in a text is replaced wherever it stands in it as a
    whole word of the same case; where it is a given and a family name there, as a family name. Repeated
    rows and equal texts give equal results, and so do reruns with the same key. An empty table gives
    no rows. A column n_entities of the input is replaced; all others may have any name.
    """
    # Packed, so that names of columns cannot meet those in use here.
    kept = [c for c in docs.columns if c != "n_entities"]
    packed = docs.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("source"))
    text_key = F.md5(F.col("source").cast("binary")).alias("text_key")
    found = materialize(
        packed.select(text_key, F.explode(matches(F.col("source"))).alias("match"))
        .select("text_key", F.explode(parts_of(F.col("match"))).alias("part")).select("text_key", "part.*").distinct()
    )
    again = materialize(found.join(redraws(found, key, rounds), ["kind", "identity"]))
    drawn = again.groupBy("text_key").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\u0001", "kind", "identity"), "draw"))).alias("draws")
    )
    # Counted by entities, as a text may have many of them.
    if again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        drawn = F.broadcast(materialize(drawn))
    joined = packed.withColumn("text_key", text_key).join(drawn, "text_key", "left")
    draws, source = F.coalesce("draws", F.create_map().cast("map<string,int>")), F.col("source")

    def rebuilt(hits: Column) -> Column:
        gaps = F.split(source, F.col("pattern"), -1)
        put = F.transform(hits, lambda s: surrogate_of(s, draws, key))
        return F.array_join(F.zip_with(gaps, put, lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))), "")

    # Mentions have no parts of their own: they are those of the names that stand with a title.
    matched = (
        joined.withColumn("titled", matches(source)).withColumn("people", people_of(F.col("titled")))
        .withColumn("pattern", pattern_of(F.col("people")))
        .withColumn("hits", F.when(
            F.size("people.words") > 0, _described(F.regexp_extract_all(source, F.col("pattern"), F.lit(0)), F.col("people"))
        ).otherwise(F.col("titled")))
    )
    new = F.when(F.size("hits") > 0, rebuilt(F.col("hits"))).otherwise(source)
    return matched.select(
        *[new.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in kept],
        F.coalesce(F.size("hits"), F.lit(0)).cast("long").alias("n_entities"),
    )
