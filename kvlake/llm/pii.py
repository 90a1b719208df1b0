"""PII: detected entities get keyed surrogates of the same type and format. DataFrame operations only.

Numbers (phones, cards, social security numbers, IBANs, IP addresses) are mapped by a keyed Feistel permutation of the
numbers with as many digits, so spellings of one number map alike and distinct numbers apart, with no table. Separators
and a phone's country code stay; a card that passes the Luhn check still does and one that fails still fails, likewise an
IBAN and its check digits, with its country and the places of its letters; an IP address stays one. E-mail addresses and
names become keyed syllable words in the script of the original (Latin, Cyrillic or Greek); a given name's ending follows
the gender of the title, or of its own ending where the title has none; titles and capitals stay; a surname maps alike
everywhere. Names are found after titles only; repeats of such a name without the title, whole or the surname alone, are
replaced in the same text. A check over the corpus's distinct entities finds those that share a surrogate, or whose
surrogate is an original; these are mapped anew until all differ. How many there are is not bounded: they stay a table.

Every part of a pattern that could run on is bounded, so time grows with the text's length whatever it holds: the local
part of an address has at most 64 characters, a domain at most 8 labels of 63.

Cases: NULL texts stay NULL, empty ones empty; texts without entities stay as they are; very long texts are taken whole
and entities never cut; repeated rows and doc_ids do not matter; all columns pass through, but for one that has a name
that starts with two underscores and is used here; empty tables give empty results.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kvlake.sources import scratch

KEY = "kvlake surrogate key"
#: Texts with entities that are mapped anew, up to which their table is broadcast.
BROADCAST = 100_000
TYPES = ("email", "ip", "ssn", "card", "iban", "phone", "name")
# Titles by gender, the alphabets of surrogate words (consonants, vowels), and endings by gender.
TITLES = {"m": ("Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "г-н", "Г-н", "господин", "Господин", "κ", "κος", "Κος", "κύριος", "Κύριος"),
          "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "г-жа", "Г-жа", "госпожа", "Госпожа", "κα", "Κα", "κυρία", "Κυρία"),
          "": ("Dr", "Prof", "д-р", "Д-р", "проф", "Проф", "Δρ", "καθ", "Καθ")}
SCRIPTS = {"Latin": ("bcdfghklmnprstvz", "aeio"), "Cyrillic": ("бвгджзклмнпрстфх", "аеио"), "Greek": ("βγδζθκλμνξπρστφχ", "αειο")}
ENDINGS = {"Latin": ("as", "ina"), "Cyrillic": ("ан", "ина"), "Greek": ("ος", "ινα")}
WORD_EMAIL, WORD_NAME = 8, 5
# Country calling codes of one and of two digits; all others have three.
CODE_1, CODE_2 = "1|7", "20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"

_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?"
#: An address starts with a letter or digit, not inside another local part.
_EMAIL = rf"(?<![\p{{L}}\p{{N}}][._%+-])[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}._%+-]{{0,63}}+@{_LABEL}(?:\.{_LABEL}){{1,7}}"
_IP = r"\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"
_SSN = r"\d{3}-\d{2}-\d{4}(?![\d-])"
# Entities may follow each other: usual groupings come before looser ones, and a phone takes no address's or security number's digits.
_GROUP = rf"(?!{_IP}|{_SSN})\d{{2,4}}"
_PHONE = (r"\+\d{1,3}[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)"
          rf"|\+\d{{1,3}}[ .-]?\(\d{{1,4}}\)[ .-]?\d{{2,4}}(?:[ .-]?{_GROUP}){{1,3}}(?!\d)|\+\d{{1,3}}(?:[ .-]{_GROUP}){{2,5}}(?!\d)"
          r"|\+\d{8,15}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|\d{3}([ .-])\d{3}\1\d{4}(?![\d-])")
_CARD = r"\d{13,19}(?!\d)|(?:\d{4}[ -]){4}\d{3}(?![ .-]?\d)|(?:\d{4} ){3}\d{1,4}(?!\d)|(?:\d{4}-){3}\d{1,4}(?!\d)|\d(?:[ -]?\d){12,18}(?![ -]?\d)"
_IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_TITLE = "(?:" + "|".join(t for ts in TITLES.values() for t in ts) + r")\.?"
_NAME = _TITLE + r" \p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?"
#: An entity starts where no letter or digit ends; alternatives in order.
ENTITY = rf"(?<![\p{{L}}\p{{N}}])(?:{_EMAIL}|{_IP}|{_SSN}|{_IBAN}|{_PHONE}|{_CARD}|{_NAME})"
#: What every text with an entity holds, and is quicker to look for.
GUARD = rf"@[\p{{L}}\p{{N}}]|\d[\d .()-]{{5}}|[A-Z]{{2}}\d{{2}} ?[A-Z0-9]{{4}}|(?<!\p{{L}}){_TITLE} \p{{Lu}}"


def entities(text: Column) -> Column:
    """All entities of a text in order, as they are spelled."""
    return F.when(text.rlike(GUARD), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind(m: Column) -> Column:
    digits = F.char_length(F.regexp_replace(m, "[^0-9]", ""))
    return (F.when(F.contains(m, F.lit("@")), F.lit("email")).when(m.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), F.lit("ip")).when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.lit("ssn"))
            .when(m.rlike(r"^[A-Z]{2}\d{2}"), F.lit("iban")).when(m.rlike(r"^\p{L}"), F.lit("name")).when(m.rlike(r"^\d") & (digits >= 13), F.lit("card")).otherwise(F.lit("phone")))


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _digest(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)


def _number(*parts) -> Column:
    return F.conv(F.substring(_digest(*parts), 1, 15), 16, 10).cast("bigint")


_POW = [10 ** k for k in range(19)]


def _pow10(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x).cast("bigint") for x in _POW]), (n + 1).cast("int"))


def _feistel(a: Column, b: Column, left: Column, right: Column, salt, key: str) -> Column:
    """A keyed permutation of (a, b) with a < left, b < right: each round adds a function of one half to the other."""
    step = lambda s, r: F.when(r % 2 == 0, F.struct(F.pmod(s["a"] + _number(key, salt, left, right, r, s["b"]), left).alias("a"), s["b"].alias("b"))).otherwise(
        F.struct(s["a"].alias("a"), F.pmod(s["b"] + _number(key, salt, left, right, r, s["a"]), right).alias("b")))
    return F.aggregate(F.array(*[F.lit(r) for r in range(6)]), F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")), step)


def permuted(digits: Column, salt, key: str) -> Column:
    """A keyed permutation of the digit strings of one length, in blocks of 18 digits."""
    def block(at: Column) -> Column:
        d = F.substring(digits, at, F.lit(18))
        n = F.char_length(d)
        p = F.floor(n / 2).cast("int")
        q = n - p
        half = lambda x: F.coalesce(x.try_cast("bigint"), F.lit(0).cast("bigint"))
        out = _feistel(half(F.substring(d, F.lit(1), p)), half(F.substring(d, p + 1, q)), _pow10(p), _pow10(q), F.concat_ws("/", F.lit(salt) if isinstance(salt, str) else salt, at.cast("string")), key)
        return F.transform(F.array(out), lambda s: F.concat(F.when(p > 0, F.lpad(s["a"].cast("string"), p, F.lit("0"))).otherwise(F.lit("")), F.lpad(s["b"].cast("string"), q, F.lit("0"))))[0]

    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(digits), F.lit(1)), F.lit(18)), block), "")


def _placed(m: Column, digits: Column) -> Column:
    """`m` with its digits replaced in turn."""
    def char(i: Column) -> Column:
        c = F.substring(m, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substring(digits, F.char_length(F.regexp_replace(F.substring(m, F.lit(1), i), "[^0-9]", "")), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.char_length(m)), char), "")


def _luhn(payload: Column) -> Column:
    """The check digit of a payload."""
    n = F.char_length(payload)
    def weighed(i: Column) -> Column:
        d = F.substring(payload, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)
    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), weighed), F.lit(0), lambda a, x: a + x)
    return F.pmod(F.lit(10) - total % 10, F.lit(10))


def _salt(name: str, attempt: Column) -> Column:
    return F.concat_ws("#", F.lit(name), attempt.cast("string"))


def _only(m: Column, keep: str = "0-9") -> Column:
    return F.regexp_replace(m, f"[^{keep}]", "")


def _digits(m: Column, salt: str, key: str, attempt: Column) -> Column:
    return _let(permuted(_only(m), _salt(salt, attempt), key), lambda x: _placed(m, x))


def _card(m: Column, key: str, attempt: Column) -> Column:
    def made(d: Column) -> Column:
        payload = F.substring(d, F.lit(1), F.char_length(d) - 1)
        off = F.pmod(F.substring(d, F.char_length(d), F.lit(1)).cast("int") - _luhn(payload), F.lit(10))
        return _let(permuted(payload, _salt("card", attempt), key), lambda p: F.concat(p, F.pmod(_luhn(p) + off, F.lit(10)).cast("string")))

    return _let(_let(_only(m), made), lambda x: _placed(m, x))


def _ip(m: Column, key: str, attempt: Column) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    valid = F.forall(o, lambda x: x <= 255)
    halves = _feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536).cast("bigint"), F.lit(65536).cast("bigint"), _salt("ip", attempt), key)
    spelled = _let(halves, lambda s: F.concat_ws(".", *[x.cast("string") for h in ("a", "b") for x in (F.floor(s[h] / 256).cast("int"), (s[h] % 256).cast("int"))]))
    return F.when(valid, spelled).otherwise(_digits(m, "ip", key, attempt))


def _phone(m: Column, key: str, attempt: Column) -> Column:
    """The digits after the country code are replaced; with or without a code, the same ones map alike."""
    digits = _only(m)
    code = F.when(F.startswith(m, F.lit("+")), F.regexp_extract(digits, rf"^(?:{CODE_1}|{CODE_2}|\d{{1,3}})", 0)).otherwise(F.lit(""))
    rest = lambda c: F.substring(digits, F.char_length(c) + 1, F.char_length(digits))
    return _let(_let(code, lambda c: F.concat(c, permuted(rest(c), _salt("phone", attempt), key))), lambda x: _placed(m, x))


def _mod97(iban: Column) -> Column:
    """What the check digits of an IBAN without spaces must be, if its own are left out of account."""
    moved = F.concat(F.substring(iban, F.lit(5), F.char_length(iban)), F.substring(iban, 1, 2), F.lit("00"))
    step = lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + c.try_cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.lit(98) - F.aggregate(F.split(moved, "(?!^)(?!$)"), F.lit(0), step)


def _iban(m: Column, key: str, attempt: Column) -> Column:
    """Country and format stay; letters are shifted by amounts that the digits and the key give."""
    def made(c: Column) -> Column:
        body = F.substring(c, F.lit(5), F.char_length(c))
        salt = F.concat_ws("/", _salt("iban", attempt), F.substring(c, 1, 2))
        off = F.pmod(F.substring(c, 3, 2).cast("int") - _mod97(c), F.lit(97))
        letter = lambda x, i: F.when(x.rlike("[A-Z]"), F.char(F.lit(65).cast("bigint") + F.pmod(F.ascii(x) - 65 + _number(key, "letter", salt, _only(body), i), F.lit(26).cast("bigint")))).otherwise(x)
        shifted = F.array_join(F.transform(F.split(body, "(?!^)(?!$)"), letter), "")
        whole = _let(shifted, lambda s: F.concat(F.substring(c, 1, 2), F.lit("00"), _let(permuted(_only(body), salt, key), lambda d: _placed(s, d))))
        return _let(whole, lambda w: F.concat(F.substring(w, 1, 2), F.lpad((F.pmod(_mod97(w) + off - 2, F.lit(97)) + 2).cast("string"), 2, "0"), F.substring(w, F.lit(5), F.char_length(w))))

    def spaced(x: Column) -> Column:
        kept = lambda i: F.when(F.substring(m, i, F.lit(1)) == " ", F.lit(" ")).otherwise(F.substring(x, F.char_length(F.replace(F.substring(m, F.lit(1), i), F.lit(" "), F.lit(""))), F.lit(1)))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.char_length(m)), kept), "")

    return _let(_let(F.replace(m, F.lit(" "), F.lit("")), made), spaced)


def _script(m: Column) -> Column:
    return F.when(m.rlike(r"\p{IsCyrillic}"), F.lit("Cyrillic")).when(m.rlike(r"\p{IsGreek}"), F.lit("Greek")).otherwise(F.lit("Latin"))


def _choose(script: Column, values: dict) -> Column:
    return F.when(script == "Cyrillic", F.lit(values["Cyrillic"])).when(script == "Greek", F.lit(values["Greek"])).otherwise(F.lit(values["Latin"]))


def _word(what: Column, salt: str, syllables: int, script: Column, key: str, attempt: Column) -> Column:
    """A keyed word: 6 bits of the digest a syllable."""
    cons, vows = _choose(script, {k: v[0] for k, v in SCRIPTS.items()}), _choose(script, {k: v[1] for k, v in SCRIPTS.items()})

    def syllable(dig: Column, i: Column) -> Column:
        b = F.conv(F.substring(dig, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return F.concat(F.substring(cons, b % 16 + 1, F.lit(1)), F.substring(vows, F.floor(b / 16).cast("int") % 4 + 1, F.lit(1)))

    return F.transform(F.array(_digest(key, salt, attempt, what)), lambda dig: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(syllables - 1)), lambda i: syllable(dig, i)), ""))[0]


def _email(m: Column, key: str, attempt: Column) -> Column:
    low, script = F.lower(m), _script(m)
    number = F.regexp_extract(m, r"([._%+-]?)\d+@", 1)
    local = F.concat(_word(low, "local", WORD_EMAIL, script, key, attempt), F.when(m.rlike(r"\d@"), F.concat(number, F.lpad(F.pmod(_number(key, "n", low), F.lit(100)).cast("string"), 2, "0"))).otherwise(F.lit("")))
    domain = F.concat(_word(F.substring_index(low, "@", -1), "domain", 6, F.lit("Latin"), key, F.lit(0)), F.lit(".example"))
    return F.concat(local, F.lit("@"), domain)


def _gender(title: Column, given: Column) -> Column:
    """0 or 1: of the title, else of the given name's ending."""
    bare = F.regexp_replace(title, r"\.$", "")
    return F.when(bare.isin(*TITLES["m"]), 0).when(bare.isin(*TITLES["f"]), 1).when(given.rlike("[aeаяαη]$"), 1).otherwise(0)


def _given(name: Column, gender: Column, key: str, attempt: Column) -> Column:
    """The surrogate of a given name (in lower case)."""
    script = _script(name)
    ending = F.element_at(F.array(*[_choose(script, {k: v[g] for k, v in ENDINGS.items()}) for g in range(2)]), gender + 1)
    return F.concat(_word(name, "given", WORD_NAME, script, key, attempt), ending)


def _family(name: Column, key: str, attempt: Column) -> Column:
    return _word(name, "family", WORD_NAME + 1, _script(name), key, attempt)


def _like(original: Column, word: Column) -> Column:
    """The word with the original's capitals: all of them, or the first."""
    return F.when((original == F.upper(original)) & (F.char_length(original) > 1), F.upper(word)).otherwise(F.initcap(word))


# An entity is checked, and mapped anew, by its canonical spelling: (type, spelling); a name has one for each of its parts.

def canonical(m: Column, k: Column) -> Column:
    return (F.when(k == "email", F.lower(m)).when(k == "iban", F.replace(m, F.lit(" "), F.lit(""))).when(k == "ip", m)
            .when(k == "phone", F.concat(F.when(F.startswith(m, F.lit("+")), "+").otherwise(F.lit("")), _only(m))).otherwise(_only(m)))


def _unit(k, spelling) -> Column:
    return F.concat_ws("|", F.lit(k) if isinstance(k, str) else k, spelling)


def units(m: Column) -> Column:
    """What of an entity has a surrogate of its own, as "type|spelling"."""
    parts = F.split(m, " ")
    low = lambda i: F.lower(F.element_at(parts, i))
    given = F.when(F.size(parts) > 2, F.concat_ws("", _gender(parts[0], low(2)).cast("string"), low(2)))
    name = F.filter(F.array(_unit("family", low(-1)), F.when(given.isNotNull(), _unit("given", given))), lambda x: x.isNotNull())
    return _let(kind(m), lambda k: F.when(k == "name", name).otherwise(F.array(_unit(k, canonical(m, k)))))


def unit_surrogate(unit: Column, key: str, attempt: Column) -> Column:
    """The unit that the surrogate would be."""
    k, x = F.substring_index(unit, "|", 1), F.substring(unit, F.length(F.substring_index(unit, "|", 1)) + 2, F.length(unit))
    gender = F.substring(x, 1, 1).try_cast("int")
    made = (F.when(k == "family", _family(x, key, attempt)).when(k == "given", F.concat(F.substring(x, 1, 1), _given(F.substring(x, F.lit(2), F.length(x)), gender, key, attempt)))
            .otherwise(_number_or_address(x, k, key, attempt)))
    return _unit(k, made)


def _number_or_address(m: Column, k: Column, key: str, attempt: Column) -> Column:
    return (F.when(k == "email", _email(m, key, attempt)).when(k == "ip", _ip(m, key, attempt)).when(k == "card", _card(m, key, attempt)).when(k == "iban", _iban(m, key, attempt))
            .when(k == "phone", _phone(m, key, attempt)).otherwise(_digits(m, "ssn", key, attempt)))


def _name_parts(m: Column, key: str, attempt) -> Column:
    """(title, given or NULL, family) of the surrogate."""
    parts = F.split(m, " ")
    low = lambda i: F.lower(F.element_at(parts, i))
    gender = _gender(parts[0], low(2))
    given = F.when(F.size(parts) > 2, _like(parts[1], _given(low(2), gender, key, attempt(_unit("given", F.concat_ws("", gender.cast("string"), low(2)))))))
    family = _like(F.element_at(parts, -1), _family(low(-1), key, attempt(_unit("family", low(-1)))))
    return F.struct(parts[0].alias("title"), given.alias("given"), family.alias("family"))


def surrogate(m: Column, key: str = KEY, attempt=None) -> Column:
    """`attempt` gives the number of times that a unit was mapped anew."""
    attempt = (lambda unit: F.lit(0)) if attempt is None else attempt
    name = _let(_name_parts(m, key, attempt), lambda n: F.concat_ws(" ", n["title"], n["given"], n["family"]))
    return _let(kind(m), lambda k: F.when(k == "name", name).otherwise(_number_or_address(m, k, key, attempt(_unit(k, canonical(m, k))))))


def collisions(found: DataFrame, key: str = KEY) -> DataFrame | None:
    """(unit, attempt) of the units whose first surrogate is not theirs alone, or is an original; None if there are none.

    `found` has the entities of each text as `__found`. A surrogate shared by several stays with the first of them."""
    own = scratch.written(found.select(F.explode(F.array_distinct(F.flatten(F.transform("__found", units)))).alias("unit")).distinct(), "units")
    state = own.withColumn("attempt", F.lit(0))
    for _ in range(32):
        made = state.withColumn("s", unit_surrogate(F.col("unit"), key, F.col("attempt")))
        made = scratch.written(made, "surrogates")
        first = made.groupBy("s").agg(F.min(F.struct(F.col("attempt") > 0, "unit")).alias("first"))  # those not mapped anew keep theirs
        judged = made.join(first, "s").join(own.select(F.col("unit").alias("s"), F.lit(True).alias("taken")), "s", "left")
        judged = judged.select("unit", "attempt", (F.col("taken").isNotNull() | (F.col("unit") != F.col("first.unit"))).alias("bad"))
        state = scratch.written(judged.select("unit", (F.col("attempt") + F.col("bad").cast("int")).alias("attempt"), "bad"), "attempts")
        if not state.filter("bad").limit(1).count():
            again = state.filter("attempt > 0").select("unit", "attempt")
            return again if again.limit(1).count() else None
        state = state.drop("bad")
    raise ValueError("surrogates still collide: there are too few of a length for the entities found")


def replace(docs: DataFrame, key: str = KEY, text_col: str = "text", check: bool = True) -> DataFrame:
    """`docs` with every entity of `text_col` replaced, and the entities' types in order as `__types`.

    Entities are extracted once: texts are written with them, and the check reads the entities alone."""
    rows = docs.withColumn("__found", entities(F.col(text_col)))
    again = None
    if check:
        rows = scratch.written(rows, "entities")
        again = collisions(rows, key)
    t = F.col(text_col)
    if again is None:
        attempt = None
    else:  # texts that hold units mapped anew, by hash: a text whose hash is another's gets more than it needs, no harm
        units_of = rows.filter(F.size("__found") > 0).select(F.xxhash64(t).alias("__h"), F.explode(F.array_distinct(F.flatten(F.transform("__found", units)))).alias("unit"))
        per = units_of.join(again, "unit").distinct().groupBy("__h").agg(F.map_from_entries(F.collect_list(F.struct("unit", "attempt"))).alias("__again"))
        per = scratch.written(per, "again")
        rows = rows.withColumn("__h", F.xxhash64(t)).join(F.broadcast(per) if per.count() <= BROADCAST else per, "__h", "left").drop("__h")
        attempt = lambda unit: F.coalesce(F.try_element_at("__again", unit), F.lit(0))
    names = F.filter("__found", lambda m: kind(m) == "name")
    rows = rows.withColumn("__new", F.transform("__found", lambda m: surrogate(m, key, attempt)))
    edge = lambda x: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), x, F.lit(r"\E(?![\p{L}\p{N}])"))
    bare = lambda m: F.substring(m, F.length(F.substring_index(m, " ", 1)) + 2, F.length(m))
    swap = lambda find, put: F.struct(edge(find).alias("find"), put.alias("put"))
    new_bare = lambda n: F.concat_ws(" ", n["given"], n["family"])
    whole = F.transform(names, lambda m: swap(bare(m), new_bare(_name_parts(m, key, attempt or (lambda unit: F.lit(0))))))
    family = F.transform(names, lambda m: swap(F.substring_index(m, " ", -1), _name_parts(m, key, attempt or (lambda unit: F.lit(0)))["family"]))
    rows = rows.withColumn("__swaps", F.when(F.size("__found") > 0, F.concat(F.array_distinct(whole), F.array_distinct(family))))
    between = F.transform(F.split(t, ENTITY, -1), lambda p: F.when(F.size("__swaps") > 0, F.aggregate("__swaps", p, lambda x, w: F.regexp_replace(x, w["find"], w["put"]))).otherwise(p))
    joined = F.array_join(F.zip_with(between, F.col("__new"), lambda p, x: F.concat(F.coalesce(p, F.lit("")), F.coalesce(x, F.lit("")))), "")
    rows = rows.withColumn(text_col, F.when(F.size("__found") > 0, joined).otherwise(t))
    return rows.withColumn("__types", F.transform("__found", kind)).drop("__found", "__new", "__swaps", "__again")
