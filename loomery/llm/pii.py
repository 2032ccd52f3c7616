"""Keyed surrogates for personal data, with DataFrame functions only.

Entities are found by one pattern. Each has a kind and a normal form (digits of a phone or card, lower case of an
address, a secret as it is), and the normal form's surrogate comes from a keyed hash in the same format; it is then written the way the
entity was (punctuation, upper case), so all mentions of an entity agree. Surrogates are checked over the whole
table: two entities never share one, and none equals an entity that occurs; whoever loses a check hashes again. The
hosts of addresses are entities of their own in these checks, so people of one host stay together and hosts apart.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm.shared import forget, written

#: Given names whose gender is plain, by gender and script: those that are detected.
GIVEN = {
    ("m", "latin"): "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Steven Paul Andrew Kenneth Hans Jürgen Wolfgang Pierre Jacques François José Carlos Miguel Giorgos Ivan".split(),
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Sandra Ashley Emily Michelle Ursula Ingrid Monika Marie Isabelle Nathalie María Carmen Lucía Zoe Olga".split(),
    ("m", "cyrillic"): "Иван Дмитрий Сергей Андрей Алексей Николай Михаил Павел".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
    ("m", "greek"): "Γιώργος Γιάννης Νίκος Κώστας".split(),
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Σοφία".split(),
}
#: Given names of the same kinds that surrogates are drawn from; none is detected.
STAND_INS = {
    ("m", "latin"): "Albert Bruno Cedric Dennis Edgar Felix Gordon Harvey Ignacio Jasper Konrad Lorenzo Marvin Norbert Oscar Percy Quentin Ralph Stefan Tobias Ulrich Victor Wesley Xavier Yannick".split(),
    ("f", "latin"): "Agatha Beatrice Cecilia Daphne Edith Flora Greta Helena Irma Josefina Klara Louisa Matilda Nadine Odette Paulina Quirina Rosalind Stella Thelma Valeria Wanda Ximena Yvonne Zelda".split(),
    ("m", "cyrillic"): "Артём Борис Виктор Глеб Егор Кирилл Леонид Максим Роман Тимур".split(),
    ("f", "cyrillic"): "Алина Вера Галина Дарья Жанна Зоя Кира Лариса Нина Тамара".split(),
    ("m", "greek"): "Αλέξανδρος Βασίλης Δημήτρης Θανάσης Πέτρος Στέλιος".split(),
    ("f", "greek"): "Αγγελική Βασιλική Δέσποινα Ειρήνη Ζωή Φωτεινή".split(),
}
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Signor Signora".split()
#: What stands before a person's whole name, so that names which aren't listed are found too.
CUES = ["my name is", "name:", "contact:", "signed,", "attn:", "ich heiße", "je m'appelle", "me llamo", "mi chiamo", "меня зовут", "με λένε"]
#: Letters that syllables of made-up names begin with, have and end in, by script.
SOUNDS = {"latin": ("bdfghklmnprstvwz", "aeiou", "lmnrs"), "cyrillic": ("бвгдзклмнпрстфхш", "аеиоу", "лмнрс"), "greek": ("βγδζθκλμνπρστφχψ", "αειου", "λμνρξ")}
#: Bytes of the entities that hashed again up to which they are sent along with the plan; beyond it the rows that have one are joined with theirs.
INLINE_BYTES, BUCKETS = 4 << 20, 1024
#: Hashes of one entity before its format counts as used up.
ATTEMPTS = 40

_NAMES = "|".join(n for names in GIVEN.values() for n in names)
_SURNAME = r"(?:\p{Lu}['’]|Ma?c)?\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
_CUE = rf"(?i:{'|'.join(CUES)})\s"
_TITLED = rf"(?:{'|'.join(TITLES)})\.?\s"
_KEYS = r"password|passwd|pwd|token|secret|api[_\-]?key"
# no entity begins within a word: nearly all places fail at the first look
_PATTERN = r"(?<![\p{L}\p{N}])(?=[\p{L}\d(+._%\-])(?:" + "|".join(
    [
        r"(?<![._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)+",
        r"(?=[\d(+])(?:" + "|".join(
            [
                r"(?<!\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
                r"(?<![\w+])\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,4}(?!\d)",
                r"(?<!\()\(\d{3}\) ?\d{3}-\d{4}(?!\d)",
                r"(?<!-)\d{3}-\d{3}-\d{4}(?![\d\-])",
                r"(?<!-)\d{3}-\d{2}-\d{4}(?![\d\-])",
                r"(?<![.\w])[3-6]\d{3}([ \-]?)\d{4}\1\d{4}\1\d{1,7}(?!\d)",
            ]
        ) + ")",
        rf"(?i:{_KEYS})[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?[A-Za-z0-9_\-/+.]{{6,}}",
        r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        r"(?=[A-Za-z]*\d)[0-9a-fA-F]{16,}(?![A-Za-z0-9])",
        rf"(?=\p{{Lu}})(?:{_TITLED}(?:(?:{_NAMES})\s)?|(?:{_NAMES})\s){_SURNAME}(?!\p{{L}})",
        rf"(?=[{''.join(sorted({c for x in CUES for c in (x[0], x[0].upper())}))}]){_CUE}\p{{Lu}}\p{{Ll}}+\s{_SURNAME}(?!\p{{L}})",
    ]
) + ")"
_NAME = rf"^({_TITLED})?(?:({_NAMES})(\s))?({_SURNAME})$"
_CUED = rf"^({_CUE})(\p{{Lu}}\p{{Ll}}+)(\s)({_SURNAME})$"


def _in(value: Column, names: list[str]) -> Column:
    return value.isin(names)


def _script(entity: Column) -> Column:
    return F.when(entity.rlike(r"\p{IsCyrillic}"), "cyrillic").when(entity.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _given_kind(entity: Column) -> Column:
    """Null for a name that isn't listed."""
    out = None
    for (gender, script), names in GIVEN.items():
        out = (F if out is None else out).when(_in(entity, names), f"given {gender} {script}")
    return out


def kind_of(entity: Column) -> Column:
    surname = F.concat(F.lit("surname "), F.when(entity.rlike(r"\p{IsCyrillic}"), F.when(entity.rlike("(а|я)$"), "f").otherwise("m")).otherwise("-"), F.lit(" "), _script(entity))
    return (
        F.when(entity.contains("@"), "email").when(entity.rlike(rf"^(?i:{_KEYS})[\"']?\s*[:=]"), "secret").when(entity.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(entity.rlike(r"^[+(]|^\d{3}-\d{3}-\d{4}$"), "phone").when(entity.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(entity.rlike(r"^[\d \-]+$"), "card")
        .when(entity.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]{11,38}$"), "iban").when(entity.rlike("^[0-9a-fA-F]{16,}$"), "secret").otherwise(F.coalesce(_given_kind(entity), surname))
    )


def _value(entity: Column, kind: Column) -> Column:
    """The part that is private: a secret stands behind its key."""
    return F.when((kind == "secret") & entity.rlike(r"[:=]"), F.regexp_extract(entity, r"([A-Za-z0-9_\-/+.]+)$", 1)).otherwise(entity)


def _normal(value: Column, kind: Column) -> Column:
    digits = F.regexp_replace(value, r"\D", "")
    # a number of ten digits is the same one with the country code 1
    return F.when((kind == "phone") & value.startswith("+1") & (F.length(digits) == 11), F.substring(digits, 2, 10)).when(kind.isin("phone", "card", "ssn"), digits).when(kind == "email", F.lower(value)).when(kind == "iban", F.replace(value, F.lit(" "))).otherwise(value)


def _byte(h: Column, i: Column | int) -> Column:
    """The i-th byte of a hex text of 256 digits, again from the start beyond it."""
    at = i if isinstance(i, Column) else F.lit(i)
    return F.conv(F.substring(h, (at % 128) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _shaped(value: Column, h: Column, shift: int = 0, letters: int = 26) -> Column:
    """Letters (the alphabet's first ones) for letters and digits for digits."""
    def letter(i: Column) -> Column:
        c, b = F.substring(value, i + 1, F.lit(1)), _byte(h, i + shift)
        return F.when(c.rlike("[0-9]"), (b % 10).cast("string")).when(c.rlike("[a-z]"), F.char(F.lit(97) + b % letters)).when(c.rlike("[A-Z]"), F.char(F.lit(65) + b % letters)).otherwise(c)

    return F.when(F.length(value) > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.length(value) - 1), letter), "")).otherwise(value)


def _luhn(digits: Column) -> Column:
    """The sum, modulo 10, that is 0 for valid numbers."""
    def one(i: Column) -> Column:
        d = F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), one), F.lit(0), lambda a, x: a + x) % 10


def _name(kind: Column, normal: Column, h: Column, attempt: Column) -> Column:
    """A given name or surname, by the kind's gender and script (the last word of the kind)."""
    def by(values: dict) -> Column:
        out = F
        for k, value in values.items():
            out = out.when(kind.endswith(k), value)
        return out

    sounds = [by({f" {k}": F.lit(x[i]) for k, x in SOUNDS.items()}) for i in range(3)]
    vowel = by({f" {k}": F.lit(x[1][0]) for k, x in SOUNDS.items()})
    pool = by({f" {gender} {script}": F.array(*[F.lit(n) for n in names]) for (gender, script), names in STAND_INS.items()})

    def syllables(k: int, n: int) -> Column:
        return F.concat(*[F.substring(x, _byte(h, 3 * j + i) % len(SOUNDS["latin"][i]) + 1, F.lit(1)) for j in range(k, k + n) for i, x in enumerate(sounds)])

    # more letters where many have met; men's names end in consonants, women's in a vowel
    made = F.initcap(F.concat(syllables(0, 2), F.when(attempt < 3, F.lit("")).otherwise(syllables(2, 1)), F.when(kind.rlike("^(given|surname) f "), vowel).otherwise("")))
    double = F.when(normal.contains("-"), F.concat(F.lit("-"), F.initcap(syllables(3, 2)))).otherwise("")
    return F.when(kind.startswith("given") & (attempt < 6), F.coalesce(F.get(pool, _byte(h, 0) % F.size(pool)), made)).otherwise(F.concat(made, double))


def _host_of(address: Column) -> Column:
    return F.substring_index(address, "@", -1)


def surrogate(kind: Column, normal: Column, attempt: Column, key: str, host_attempt: Column | None = None) -> Column:
    """The surrogate of a normal form, as a normal form; host_attempt: that of an address's host (0)."""
    whole = lambda *parts: F.sha2(F.concat_ws("|", F.lit(key), *parts), 512)
    doubled = lambda once, body: _let(once, lambda o: _let(F.concat(o, F.sha2(o, 512)), body))
    n = F.length(normal)

    def made(h: Column) -> Column:
        digits = lambda first, count: F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: (_byte(h, i + first) % 10).cast("string")), "")
        code = F.greatest(n - 10, F.lit(0))
        more = F.when(attempt < 8, F.lit("")).otherwise(F.concat(F.lit("."), F.substring(h, 100, 8)))

        def host(d: Column) -> Column:
            where = F.when(kind == "host", normal).otherwise(_host_of(normal))
            tries = F.when(kind == "host", attempt).otherwise(F.lit(0) if host_attempt is None else host_attempt)
            label = F.concat(_shaped(F.substring_index(where, ".", 1), d), F.when(tries < 3, F.lit("")).otherwise(F.substring(d, 100, 8)))
            return F.concat(label, F.lit(".example."), F.get(F.array(F.lit("com"), F.lit("net"), F.lit("org")), _byte(d, 0) % 3))

        def checked(body: Column) -> Column:
            zero = (10 - _luhn(F.concat(body, F.lit("0")))) % 10  # valid numbers stay valid, others as far off as they were
            return F.concat(body, ((zero + _luhn(normal)) % 10).cast("string"))

        return (
            F.when(kind == "email", F.concat(_shaped(F.substring_index(normal, "@", 1), h), more, F.lit("@"), doubled(whole(F.lit("host"), _host_of(normal), (F.lit(0) if host_attempt is None else host_attempt).cast("string")), host)))
            .when(kind == "host", host(h))
            .when(kind == "ip", F.concat_ws(".", (F.lit(11) + _byte(h, 0) % 116).cast("string"), _byte(h, 1).cast("string"), _byte(h, 2).cast("string"), (F.lit(1) + _byte(h, 3) % 254).cast("string")))
            .when(kind == "phone", F.concat(F.substring(normal, F.lit(1), code), (F.lit(2) + _byte(h, 20) % 8).cast("string"), digits(0, n - code - 1)))
            .when(kind == "ssn", F.concat(F.lit("9"), digits(0, n - 1)))
            .when(kind == "card", _let(F.concat(F.substring(normal, 1, 1), digits(0, n - 2)), checked))
            .when(kind == "iban", F.concat(F.substring(normal, 1, 2), _shaped(F.substring(normal, F.lit(3), n), h)))
            .when((kind == "secret") & normal.rlike("^[0-9a-fA-F]+$"), _shaped(normal, h, letters=6))
            .when(kind == "secret", _shaped(normal, h))
            .otherwise(_name(kind, normal, h, attempt))
        )

    return doubled(whole(kind, normal, attempt.cast("string")), made)


def _rendered(entity: Column, kind: Column, value: Column, new: Column) -> Column:
    """The surrogate written as the entity was."""
    digits = F.length(F.regexp_replace(value, r"\D", ""))
    new = F.when((kind == "phone") & (digits == F.length(new) + 1), F.concat(F.lit("1"), new)).otherwise(new)

    def digit(i: Column) -> Column:
        c = F.substring(value, i + 1, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substring(new, F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), r"\D", "")), F.lit(1))).otherwise(c)

    def sign(i: Column) -> Column:
        c = F.substring(value, i + 1, F.lit(1))
        return F.when(c == " ", c).otherwise(F.substring(new, F.length(F.replace(F.substring(value, F.lit(1), i + 1), F.lit(" "))), F.lit(1)))

    place = F.sequence(F.lit(0), F.length(value) - 1)
    cased = F.when((value == F.upper(value)) & (value != F.lower(value)), F.upper(new)).otherwise(new)
    body = F.when(kind.isin("phone", "card", "ssn"), F.array_join(F.transform(place, digit), "")).when(kind == "iban", F.array_join(F.transform(place, sign), "")).when(kind == "email", cased).otherwise(new)
    return F.concat(F.substring(entity, F.lit(1), F.length(entity) - F.length(value)), body)


def _mention(lead: Column, entity: Column, kind: Column | None = None) -> Column:
    kind = kind_of(entity) if kind is None else kind
    value = _value(entity, kind)
    return F.struct(lead.alias("lead"), entity.alias("entity"), kind.alias("kind"), value.alias("value"), _normal(value, kind).alias("normal"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _mentions(match: Column) -> Column:
    """A match's mentions: a title stays, a given name and a surname are two entities, anything else is one."""
    part = lambda k: F.regexp_extract(match, _NAME, k)
    cued = lambda k: F.regexp_extract(match, _CUED, k)
    found = _mention(cued(1), cued(2), F.coalesce(_given_kind(cued(2)), F.concat(F.lit("given - "), _script(cued(2)))))
    given = F.when(part(2) != "", _mention(part(1), part(2)))
    surname = _mention(F.when(part(2) != "", part(3)).otherwise(part(1)), part(4))
    return F.when(match.rlike(_NAME), F.array_compact(F.array(given, surname))).when(match.rlike(_CUED), F.array(found, _mention(cued(3), cued(4)))).otherwise(F.array(_mention(F.lit(""), match)))


def entities(text: Column) -> Column:
    """For each match, in the order of the text, its mentions (lead, entity, kind, value, normal); empty for null."""
    return F.transform(F.coalesce(F.regexp_extract_all(text, F.lit(_PATTERN), F.lit(0)), F.array().cast("array<string>")), _mentions)


def _settled(real: DataFrame, made: Column, attempts: int) -> DataFrame:
    """real (kind, normal, host_attempt) with attempt and new, which made gives: no other row's, and no row's normal, within the kind."""
    own = ["kind", "normal", "host_attempt"]
    again = lambda df: df.withColumn("new", made)
    n = int(real.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but work in each row
    now = written(again(real.repartition(n, "kind", "normal").withColumn("attempt", F.lit(0))), "surrogates")
    for _ in range(attempts):
        owner = now.groupBy("kind", "new").agg(F.min(F.struct("attempt", "normal")).alias("o"), F.count("*").alias("n")).where("n > 1").select("kind", "new", F.col("o.normal").alias("owner"))
        clash = now.join(owner, ["kind", "new"]).where("normal != owner").select("kind", "normal")
        taken = now.join(real.select("kind", F.col("normal").alias("new")), ["kind", "new"], "left_semi").select("kind", "normal")
        bad = written(clash.union(taken).distinct(), "clashes")
        if bad.limit(1).count() == 0:
            forget(bad)
            return now
        moved = again(now.join(bad, ["kind", "normal"], "left_semi").select(*own, (F.col("attempt") + 1).alias("attempt")))
        old, now = now, written(now.join(bad, ["kind", "normal"], "left_anti").select(*own, "attempt", "new").unionByName(moved), "surrogates")
        forget(old, bad)
    raise RuntimeError("a format has too few surrogates for its entities")


def assign(found: DataFrame, key: str, attempts: int = ATTEMPTS) -> DataFrame:
    """kind, normal, attempt, new for the distinct kind and normal of found, and for the hosts of its addresses (kind host).

    new is no other row's, and no row's normal, within the kind. A kind of which nearly all values occur raises an error: its format
    can't keep so many entities distinct.
    """
    real = written(found.select("kind", "normal").distinct(), "entities")
    made = surrogate(F.col("kind"), F.col("normal"), F.col("attempt"), key, F.col("host_attempt"))
    hosts = _settled(real.where("kind = 'email'").select(F.lit("host").alias("kind"), _host_of(F.col("normal")).alias("normal"), F.lit(0).alias("host_attempt")).distinct(), made, attempts)
    by_host = real.withColumn("h", F.when(F.col("kind") == "email", _host_of(F.col("normal"))))
    placed = by_host.join(hosts.select(F.col("normal").alias("h"), F.col("attempt").alias("host_attempt")), "h", "left").select("kind", "normal", F.coalesce("host_attempt", F.lit(0)).alias("host_attempt"))
    return _settled(placed, made, attempts).unionByName(hosts).select("kind", "normal", "attempt", "new")


def replace_pii(docs: DataFrame, key: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with surrogates in its text and with n_entities.

    Where a text has a person's name, its bare mentions of that name are replaced too. People are found by a title, a listed given
    name or a cue (CUES) before the name; others stay, unless such a mention of theirs is in the same text. An empty key is an error.
    Null texts stay null, texts without entities as they are (n_entities 0). Rows repeat as they are; equal entities get
    equal surrogates in all rows. An empty table gives an empty one. A column n_entities of docs is replaced.
    """
    if not key:
        raise ValueError("surrogates need a secret key")
    names = [c for c in docs.columns if c.lower() != "n_entities"]
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    body, own = (f"c{names.index(c)}" for c in (text, doc_id))
    each = F.flatten(entities(F.col(body)))
    found = plain.select(F.explode(each).alias("e")).select("e.kind", "e.normal")
    table = assign(found, key)
    moved = table.where("attempt > 0").select(F.concat_ws("|", "kind", "normal").alias("x"), "attempt")
    size = moved.agg(F.sum(F.octet_length("x") + 16)).first()[0] or 0
    if not size:
        attempt = lambda kind, normal: F.lit(0)
    elif size <= INLINE_BYTES:  # a constant of the plan, by the names' hashes
        known: list[dict] = [{} for _ in range(BUCKETS)]
        for r in moved.withColumn("b", F.pmod(F.xxhash64("x"), F.lit(BUCKETS))).collect():
            known[r.b][r.x] = r.attempt
        again = F.from_json(F.lit(json.dumps(known)), "array<map<string,int>>")
        name = lambda kind, normal: F.concat_ws("|", kind, normal)
        attempt = lambda kind, normal: F.coalesce(F.try_element_at(F.get(again, F.pmod(F.xxhash64(name(kind, normal)), F.lit(BUCKETS)).cast("int")), name(kind, normal)), F.lit(0))
    else:  # the rows with entities that hashed again get a map of theirs
        plain = plain.withColumn("k", F.struct(F.xxhash64(own, body), F.xxhash64(F.lit(1), body, own)))
        mine = plain.select("k", F.explode(each).alias("e")).select("k", F.explode(F.array(F.concat_ws("|", "e.kind", "e.normal"), F.when(F.col("e.kind") == "email", F.concat_ws("|", F.lit("host"), _host_of(F.col("e.normal")))))).alias("x")).distinct()
        again = mine.join(moved, "x").groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("x", "attempt"))).alias("m"))
        plain = plain.join(again, "k", "left")
        attempt = lambda kind, normal: F.coalesce(F.try_element_at("m", F.concat_ws("|", kind, normal)), F.lit(0))

    def written_anew(x: Column) -> Column:
        name = F.when(x["kind"].rlike("^(given|surname) "), x["value"])
        host = F.when(x["kind"] == "email", attempt(F.lit("host"), _host_of(x["normal"]))).otherwise(0)
        return _let(surrogate(x["kind"], x["normal"], attempt(x["kind"], x["normal"]), key, host), lambda new: F.struct(F.concat(x["lead"], _rendered(x["entity"], x["kind"], x["value"], new)).alias("out"), name.alias("name"), new.alias("new")))

    def bare(gap: Column, names: Column) -> Column:
        """text, n: a gap between matches with the text's own names replaced, and how many there were."""
        pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform(names, lambda x: x["name"]), "|"), F.lit(r")(?![\p{L}\p{N}])"))
        new = lambda hit: F.get(F.filter(names, lambda x: x["name"] == hit), F.lit(0))["new"]

        def replaced(hits: Column) -> Column:
            parts = F.zip_with(F.split(gap, pattern), hits, lambda g, hit: F.concat(g, F.when(hit.isNull(), F.lit("")).otherwise(new(hit))))
            return F.struct(F.array_join(parts, "").alias("text"), F.size(hits).alias("n"))

        return F.when(F.size(names) == 0, F.struct(gap.alias("text"), F.lit(0).alias("n"))).otherwise(_let(F.regexp_extract_all(gap, pattern, F.lit(0)), replaced))

    def whole(made: Column) -> Column:
        """joined, n_entities of a text with matches."""
        people = F.filter(F.flatten(made), lambda x: x["name"].isNotNull())
        gaps = _let(F.array_distinct(F.transform(people, lambda x: F.struct(x["name"].alias("name"), x["new"].alias("new")))), lambda names: F.transform(F.split(F.col(body), _PATTERN), lambda g: bare(g, names)))

        def joined(parts: Column) -> Column:
            text = F.array_join(F.zip_with(parts, made, lambda g, m: F.concat(g["text"], F.coalesce(F.array_join(F.transform(m, lambda x: x["out"]), ""), F.lit("")))), "")
            count = F.size(F.flatten(made)) + F.aggregate(parts, F.lit(0), lambda a, g: a + g["n"])
            return F.struct(text.alias("joined"), count.cast("long").alias("n_entities"))

        return _let(gaps, joined)

    def result(matches: Column) -> Column:
        made = F.transform(matches, lambda m: F.transform(m, written_anew))
        return F.when(F.size(matches) > 0, _let(made, whole)).otherwise(F.struct(F.col(body).alias("joined"), F.lit(0).cast("long").alias("n_entities")))

    # a generator makes its row once, whatever is taken from it
    kept = [f"c{i}" for i, c in enumerate(names) if c != text]
    out = plain.select(*kept, F.inline(F.transform(F.array(entities(F.col(body))), result)))
    return out.select(*[F.col("joined" if c == text else f"c{i}").alias(c) for i, c in enumerate(names)], "n_entities")
