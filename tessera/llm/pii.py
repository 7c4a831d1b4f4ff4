"""Personal data: detected entities get keyed surrogates of the same type, format, script and gender, all in column expressions."""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import name, saved

#: Titles with the gender that they tell, or without one.
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа", "Госпожа"]
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "Господин"]
NEUTRAL = ["Dr", "Prof", "Д-р"]
#: Syllables of surrogate names by script, and the ends of given names and surnames by script and gender.
SYLLABLES = {"latin": "ba be bo da de do fa fe ga ge ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va".split(), "cyrillic": "ба бе бо да де до фа фе га ге ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то ва".split()}
ENDS = {
    "given": {("latin", "f"): "na", ("latin", "m"): "nor", ("latin", "n"): "ni", ("cyrillic", "f"): "на", ("cyrillic", "m"): "нор", ("cyrillic", "n"): "ни"},
    "surname": {("latin", "f"): "son", ("latin", "m"): "son", ("latin", "n"): "son", ("cyrillic", "f"): "нова", ("cyrillic", "m"): "нов", ("cyrillic", "n"): "нко"},
}
_LATIN, _CYRILLIC, _HEX = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "0123456789abcdef"

_WORD, _OCTET = r"\p{L}\p{N}", r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Types in the order of their claim, each a Java pattern without groups that capture. Quantifiers are possessive or
#: bounded, and each starts where no such run goes on, so a text is read once.
PATTERNS = {
    "email": rf"(?<![{_WORD}._%+-])[{_WORD}._%+-]{{1,64}}+@[{_WORD}-]{{1,63}}+(?:\.[{_WORD}-]{{1,63}}+){{1,10}}",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{32,}+|(?:AKIA|ghp_|gho_|sk-|xoxb-)[A-Za-z0-9_-]{16,}+)(?![0-9A-Za-z])",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,}+",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)",
    "name": rf"(?<!\p{{L}})(?:{'|'.join(FEMALE + MALE + NEUTRAL)})\.? \p{{Lu}}[\p{{L}}'-]{{1,40}}(?: \p{{Lu}}[\p{{L}}'-]{{1,40}})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Inside a run of digits that is no card as a whole: everything else.
REST = "|".join(f"(?:{p})" for k, p in PATTERNS.items() if k != "card")
#: How many digits the groups of a printed card number have.
CARD_GROUPS = ["4,4,4,4", "4,6,5", "4,4,4,4,3"]
_SPARE = 3  # attempts before a type of fixed length grows by a sign an attempt


def _maybe(text: Column) -> Column:
    """A cheap test that every text with an entity passes: it has an @, a digit, a long hex run, a key's prefix or a title."""
    return reduce(lambda a, b: a | b, [text.contains("@"), text.rlike("[0-9]"), text.rlike("[a-fA-F]{32}"), *(text.contains(x) for x in ("AKIA", "ghp_", "gho_", "sk-", "xoxb-", *FEMALE, *MALE, *NEUTRAL))])


def _luhn(digits: Column) -> Column:
    """Whether the check digit of a run of digits is right."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10 == 0


def _is_card(digits: Column) -> Column:
    return F.length(digits).between(13, 19) & _luhn(digits)


def _kind(surface: Column) -> Column:
    """The type of a match, "none" for a run of digits that isn't one card."""
    found = reduce(lambda rest, x: F.when(surface.rlike(rf"\A(?:{x[1]})\z"), x[0]).otherwise(rest), reversed(list(PATTERNS.items())), F.lit("none"))
    return F.when((found == "card") & ~_is_card(F.regexp_replace(surface, r"\D", "")), "none").otherwise(found)


def _let(value: Column, then) -> Column:
    """then(value), where value is computed once however often it occurs."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _searched(plain: Column, pattern: Column, hit: Column) -> Column:
    """plain as an array of (plain, hit): what lies before a match, and the match. The last has the hit given."""
    return F.zip_with(F.split(plain, pattern, -1), F.concat(F.regexp_extract_all(plain, pattern, 0), F.array(hit)), lambda a, b: F.struct(a.alias("plain"), b.alias("hit")))


def _in_run(run: Column) -> Column:
    """A run of digits, blanks and dashes as (plain, hit): the cards among its groups, and the other entities between them.

    A card is some groups in a row with 13 to 19 digits and a valid check digit, the first that begins leftmost and the
    longest of these. Groups printed as cards are (or one group alone) go first; only a run without such is searched for others.
    """
    none = F.lit(None).cast("string")

    def of(g: Column, signs: Column) -> Column:
        joined = lambda a, b: F.array_join(F.slice(g, a + 1, F.greatest(b - a + 1, F.lit(0))), "")
        text = lambda a, b: F.array_join(F.transform(F.slice(F.arrays_zip(g.alias("g"), signs.alias("s")), a + 1, F.greatest(b - a + 1, F.lit(0))), lambda x: F.concat(x["g"], F.coalesce(x["s"], F.lit("")))), "")
        shape = lambda a, b: F.array_join(F.transform(F.slice(g, a + 1, b - a + 1), lambda x: F.length(x).cast("string")), ",")

        def picks(printed: bool) -> Column:
            fits = lambda i, j: _is_card(joined(i, j)) & ((i == j) | shape(i, j).isin(*CARD_GROUPS) if printed else F.lit(True))
            start = F.expr("struct(0 as next, cast(array() as array<struct<a:int,b:int>>) as picks)")

            def step(state: Column, i: Column) -> Column:
                last = F.array_max(F.filter(F.sequence(i, F.least(i + 18, F.size(g) - 1)), lambda j: fits(i, j)))
                grown = _let(last, lambda j: F.when(j.isNull(), state).otherwise(F.struct((j + 1).alias("next"), F.concat(state["picks"], F.array(F.struct(i.alias("a"), j.alias("b")))).alias("picks"))))
                return F.when(i < state["next"], state).otherwise(grown)

            return F.aggregate(F.sequence(F.lit(0), F.size(g) - 1), start, step)["picks"]

        def cut(state: Column, x: Column) -> Column:
            card = F.concat(text(x["a"], x["b"] - 1), F.get(g, x["b"]))
            token = F.struct(F.concat(state["sign"], text(state["next"], x["a"] - 1)).alias("plain"), card.alias("hit"))
            return F.struct((x["b"] + 1).alias("next"), F.coalesce(F.get(signs, x["b"]), F.lit("")).alias("sign"), F.concat(state["out"], F.array(token)).alias("out"))

        def ended(state: Column) -> Column:
            return F.concat(state["out"], F.array(F.struct(F.concat(state["sign"], text(state["next"], F.size(g) - 1)).alias("plain"), none.alias("hit"))))

        start = F.expr("struct(0 as next, '' as sign, cast(array() as array<struct<plain:string,hit:string>>) as out)")
        chosen = _let(picks(True), lambda p: F.when(F.size(p) > 0, p).otherwise(picks(False)))
        return F.aggregate(chosen, start, cut, ended)

    tokens = _let(F.regexp_extract_all(run, F.lit(r"\d+"), 0), lambda g: _let(F.regexp_extract_all(run, F.lit("[ -]"), 0), lambda signs: of(g, signs)))
    return F.flatten(F.transform(tokens, lambda x: _searched(x["plain"], F.lit(REST), x["hit"])))


def _norm(kind: Column, surface: Column) -> Column:
    """What all spellings of an entity share: lower-case addresses, else bare digits and letters."""
    return F.when(kind.isin("local", "domain"), F.lower(surface)).when(kind.isin("ip", "secret", "surname", "given"), surface).otherwise(F.upper(F.regexp_replace(surface, r"[^0-9A-Za-z]", "")))


def _mac(key: str, message: Column) -> Column:
    """HMAC of a text with SHA-512, as hex digits."""
    raw = key.encode()
    if len(raw) > 128:
        raise ValueError("a key has at most 128 bytes")
    inner, outer = (bytes(k ^ pad for k in raw.ljust(128, b"\0")) for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(F.lit(inner), message.cast("binary")), 512)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 512)


def _stream(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """128 numbers from 0 to 255 that only the key's holder can tell."""
    hex_ = F.concat(*(_mac(key, F.concat_ws("\u0001", F.lit(half), kind, attempt.cast("string"), norm)) for half in "01"))
    return F.transform(F.sequence(F.lit(0), F.lit(127)), lambda k: F.conv(F.substring(hex_, k * 2 + 1, F.lit(2)), 16, 10).cast("int"))


def _pick(letters: str, own: Column, k: Column) -> Column:
    return F.substring(F.lit(letters), F.get(own, k % 128) % len(letters) + 1, F.lit(1))


def _filled(surface: Column, own: Column, hex_: bool = False) -> Column:
    """surface with its letters and digits drawn anew: digits stay digits, cases and scripts stay, the rest is untouched."""

    def drawn(c: Column, k: Column) -> Column:
        if hex_:
            return F.when(c.rlike("[0-9a-f]"), _pick(_HEX, own, k)).when(c.rlike("[A-F]"), _pick(_HEX.upper(), own, k)).otherwise(c)
        return (
            F.when(c.rlike("[0-9]"), _pick("0123456789", own, k)).when(c.rlike(r"\p{IsCyrillic}"), F.when(F.lower(c) == c, _pick(_CYRILLIC, own, k)).otherwise(F.upper(_pick(_CYRILLIC, own, k))))
            .when(c.rlike(r"\p{Lu}"), _pick(_LATIN.upper(), own, k)).when(c.rlike(r"\p{L}"), _pick(_LATIN, own, k)).otherwise(c)
        )

    chars = F.split(surface, "")
    solid = lambda i: F.length(F.regexp_replace(F.substring(surface, F.lit(1), i), r"[^\p{L}\p{N}]", ""))
    return F.array_join(F.transform(chars, lambda c, i: drawn(c, solid(i))), "")


def _more(letters: str, own: Column, count: Column) -> Column:
    return F.when(count > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda k: _pick(letters, own, k + 96)), "")).otherwise("")


def _spelled(kind: Column, surface: Column, own: Column, attempt: Column) -> Column:
    """The surrogate of one spelling of an entity that has no parts. Spellings of one entity draw the same letters and digits."""
    grown = attempt - _SPARE
    ip = F.array_join(F.transform(F.split(surface, r"\."), lambda _, i: F.when(i == 0, F.get(own, i) % 15 + 240).otherwise(F.get(own, i)).cast("string")), ".")
    digits = _filled(surface, own)
    short = F.concat(F.regexp_replace(digits, r"\d(\D*)$", ""), _more("0123456789", own, grown))
    check = F.array_join(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.when(_luhn(F.regexp_replace(F.concat(short, d.cast("string")), r"\D", "")), d.cast("string")).otherwise("")), lambda x: x != ""), "")
    code = F.regexp_extract(surface, r"^(\+\d{1,3}(?=[ .(-])|[A-Z]{2}\d{2}|)", 1)
    kept = F.concat(code, F.substring(digits, F.length(code) + 1, F.length(digits)))
    iban = F.concat(kept, _more("0123456789", own, grown))
    prefix = F.regexp_extract(surface, r"^(AKIA|ghp_|gho_|sk-|xoxb-|)", 1)
    secret = F.when(prefix != "", F.concat(prefix, F.substring(digits, F.length(prefix) + 1, F.length(digits)))).otherwise(_filled(surface, own, hex_=True))
    rest = F.when(kind == "secret", secret).when(kind.isin("phone", "iban"), kept).otherwise(digits)
    return F.when(kind == "ip", ip).when(kind == "card", F.concat(short, check)).when(kind == "iban", F.concat(F.substring(surface, 1, 2), _iban_check(iban), F.substring(iban, F.lit(5), F.length(iban)))).otherwise(F.concat(rest, _more("0123456789", own, grown)))


def _iban_check(iban: Column) -> Column:
    """The two check digits that an IBAN needs, by the rest of it."""
    moved = F.upper(F.regexp_replace(F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 2), F.lit("00")), " ", ""))
    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda n, c: F.when(c == "", n).when(c.rlike("[0-9]"), (n * 10 + c.try_cast("int")) % 97).otherwise((n * 100 + F.ascii(c) - 55) % 97))
    return F.lpad((98 - rest).cast("string"), 2, "0")


def _by_script(part: Column, of) -> Column:
    return F.when(part.rlike(r"\p{IsCyrillic}"), of("cyrillic")).otherwise(of("latin"))


def _drawn(left: DataFrame, key: str) -> DataFrame:
    """left (kind, norm, surface, attempt) with drawn, the surrogate that an attempt gives an entity; names get it without their end."""
    kind, norm, surface, attempt, own = (F.col(c) for c in ("kind", "norm", "surface", "attempt", "own"))
    stem = _by_script(norm, lambda script: F.array_join(F.transform(F.sequence(F.lit(0), attempt + 2), lambda k: F.get(F.array(*map(F.lit, SYLLABLES[script])), F.get(own, k % 128) % 32)), ""))
    top = F.regexp_extract(norm, r"(\.[^.]*)$", 1)
    domain = F.concat(_filled(F.regexp_replace(norm, r"\.[^.]*$", ""), own), _more(_LATIN, own, attempt), top)
    local = F.concat(_filled(F.substring_index(norm, "@", 1), own), _more(_LATIN, own, attempt), F.lit("@"), F.substring_index(norm, "@", -1))
    found = F.when(kind.isin("surname", "given"), stem).when(kind == "domain", domain).when(kind == "local", local).otherwise(_norm(kind, _spelled(kind, surface, own, attempt)))
    return left.withColumn("own", _stream(key, kind, norm, attempt)).withColumn("drawn", found).drop("own")


def _settled(entities: DataFrame, key: str) -> DataFrame:
    """kind, norm, attempt and drawn of every entity (kind, norm, surface): no two of a kind share drawn, nor has one another's own value.

    Of entities that collide the first by value keeps what it drew, the others draw again, with longer values where a
    type's format can't be free for ever; each round is an aggregate and a join over what is undecided and what is taken.
    """
    width = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = saved(entities.withColumn("attempt", F.lit(0)), "entities")
    whole = left.filter("kind not in ('surname', 'given', 'local')").select("kind", F.col("norm").alias("drawn"))
    ends = [(k, e) for k, of in ENDS.items() for e in sorted(set(of.values()))]
    cut = [left.filter((F.col("kind") == k) & F.col("norm").endswith(e)).select("kind", F.lower(F.expr(f"left(norm, length(norm) - {len(e)})")).alias("drawn")) for k, e in ends]
    avoid = saved(reduce(DataFrame.union, cut, whole).distinct(), "originals")
    taken: list[DataFrame] = []
    while True:
        drawn = saved(_drawn(left.repartition(width, "kind", "norm"), key), "drawn")
        free = drawn.join(avoid, ["kind", "drawn"], "left_anti")
        for held in taken:
            free = free.join(held.select("kind", "drawn"), ["kind", "drawn"], "left_anti")
        won = free.groupBy("kind", "drawn").agg(F.min(F.struct("norm", "attempt")).alias("w")).select("kind", "w.norm", "w.attempt", "drawn")
        taken.append(saved(won, "taken"))
        left = saved(drawn.drop("drawn").join(taken[-1].select("kind", "norm"), ["kind", "norm"], "left_anti").withColumn("attempt", F.col("attempt") + 1), "entities")
        if left.isEmpty():
            return reduce(DataFrame.union, taken)


def _mapping(spellings: DataFrame, key: str) -> DataFrame:
    """kind, surface and surrogate of every distinct spelling (kind, surface, n). An address is its local part and its domain, a
    name its given name and its surname, and a bare name a surname: each is an entity of its own, so what texts share stays
    shared. A person (given name and surname) has the gender that most titles before it tell, so has a bare surname."""
    kind, surface = F.col("kind"), F.col("surface")
    words = F.split(F.regexp_replace(surface, r"\A\S+ ", ""), " ")
    domain = F.lower(F.substring_index(surface, "@", -1))
    one = F.when(kind == "email", "local").when(kind.isin("name", "bare"), "surname").otherwise(kind)
    two = F.when(kind == "email", "domain").when((kind == "name") & (F.size(words) > 1), "given")
    title = F.regexp_replace(F.regexp_extract(surface, r"\A(\S+) ", 1), r"\.", "")
    told = F.when(kind != "name", 0).when(title.isin(*FEMALE), F.col("n")).when(title.isin(*MALE), -F.col("n")).otherwise(0).alias("told")
    spellings = spellings.select("kind", "surface", told, one.alias("k1"), F.when(kind == "name", F.get(words, F.size(words) - 1)).otherwise(_norm(one, surface)).alias("n1"), two.alias("k2"), F.when(kind == "email", domain).when(two == "given", F.get(words, F.lit(0))).alias("n2"))
    spellings = saved(spellings, "spellings")
    parts = spellings.select(F.col("k1").alias("kind"), F.col("n1").alias("norm"), "surface").union(spellings.filter("k2 is not null").select("k2", "n2", "n2"))
    taken = _settled(parts.groupBy("kind", "norm").agg(F.min("surface").alias("surface")), key)
    first = taken.select(F.col("kind").alias("k1"), F.col("norm").alias("n1"), F.col("drawn").alias("d1"), "attempt")
    second = taken.select(F.col("kind").alias("k2"), F.col("norm").alias("n2"), F.col("drawn").alias("d2"))
    who = lambda rows, *by: rows.filter("kind = 'name'").groupBy(*by).agg(F.sum("told").alias("sum_told"), F.count_if(F.col("told") != 0).alias("n_told"))
    persons = who(spellings.filter("n2 is not null"), "n1", "n2").select(F.lit("name").alias("kind"), "n1", "n2", "sum_told", "n_told").union(who(spellings, "n1").select(F.lit("bare"), "n1", F.lit(None).cast("string"), "sum_told", "n_told"))
    width = int(spellings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = spellings.alias("s").join(persons.alias("p"), (F.col("s.kind") == F.col("p.kind")) & (F.col("s.n1") == F.col("p.n1")) & F.col("s.n2").eqNullSafe(F.col("p.n2")), "left").select("s.*", "sum_told", "n_told")
    placed = placed.join(first, ["k1", "n1"]).join(second, ["k2", "n2"], "left").repartition(width, "kind", "surface").withColumn("own", _stream(key, F.col("k1"), F.col("n1"), F.col("attempt")))

    own, attempt = F.col("own"), F.col("attempt")
    at = F.substring_index(surface, "@", -1)
    host = F.when(at == F.upper(at), F.upper("d2")).otherwise(F.col("d2"))
    local, more = F.substring_index(surface, "@", 1), _more(_LATIN, own, attempt)
    email = F.concat(_filled(local, own), F.when((local == F.upper(local)) & (local != F.lower(local)), F.upper(more)).otherwise(more), F.lit("@"), host)
    mark = F.regexp_extract(surface, r"\A(\S+) ", 1)
    sure = F.when(F.coalesce("n_told", F.lit(0)) > 0, F.col("sum_told")).otherwise(F.col("told"))
    gender = F.when(F.coalesce("n_told", F.lit(0)) + F.abs("told") == 0, "n").when(sure >= 0, "f").otherwise("m")
    ended = lambda part, stem, norm: F.initcap(F.concat(stem, _by_script(norm, lambda script: F.when(gender == "f", ENDS[part][script, "f"]).when(gender == "m", ENDS[part][script, "m"]).otherwise(ENDS[part][script, "n"]))))
    surname = ended("surname", F.col("d1"), F.col("n1"))
    person = F.concat_ws(" ", mark, F.when(F.col("d2").isNotNull(), ended("given", F.col("d2"), F.col("n2"))), surname)
    return placed.select("kind", "surface", F.when(kind == "email", email).when(kind == "name", person).when(kind == "bare", surname).otherwise(_spelled(kind, surface, own, attempt)).alias("surrogate"))


def session_key(spark: SparkSession) -> str:
    """The key in tessera.pii.key, the same for all jobs that must agree; where it is unset, a fresh one that nobody keeps."""
    return spark.conf.get("tessera.pii.key", None) or secrets.token_hex(32)


def replace_entities(docs: DataFrame, key: str, text_col: str = "text", added: tuple[str, str] | None = ("n_entities", "entity_kinds")) -> DataFrame:
    """docs, with every entity in text_col replaced, and the columns added: their number, and their sorted types. Rows and other columns stay.

    A surrogate depends on the key, the type and the entity, and on the table's other entities where two would collide:
    then the first by value keeps what it drew. Within a table the same entity gets the same surrogate in every text, and
    so do an address's domain, a person's given name and surname; different ones get different ones. A surname that a
    title introduced is replaced wherever it stands as a word of that text. Cards and IBANs have valid check digits
    before and after; a run of digits that is no card as a whole is searched again for cards, phones and the rest inside.
    Phones keep the country code, names the script and the gender that most titles of the person tell (women first
    where as many tell either). IP surrogates lie in 240.0.0.0/4, which nobody is assigned. A value grows by a letter or
    digit where its format has no free one; IPv4 addresses can't, so their own number must leave some free.
    Each text is searched once; what it matched is kept as a table, and only matches meet their surrogates. Null text
    stays null, texts without an entity pass without a shuffle, repeated rows are each returned, an empty table gives an
    empty result. Columns of docs may have any names; those named as the added ones are overwritten, and added=None adds none.
    """
    others = [c for c in docs.columns if c != text_col and c not in (added or ())]
    order = [c for c in docs.columns if c not in (added or ())]
    text, none = F.col(name(text_col)).cast("string"), F.expr("cast(array() as array<string>)")
    row = F.struct(F.lit(None).cast("int").alias("none"), *(F.col(name(c)).alias(f"c{i}") for i, c in enumerate(others)))
    rows = docs.select(row.alias("row"), text.alias("text"), F.monotonically_increasing_id().alias("uid"))
    hits = lambda of: F.transform(of, lambda x: x["hit"])
    rows = rows.withColumn("tokens", F.when(_maybe(F.col("text")), _searched(F.col("text"), F.lit(ANY), F.lit(None).cast("string"))))
    loose = lambda x: F.coalesce(x["hit"].rlike(rf"\A(?:{PATTERNS['card']})\z") & (_kind(x["hit"]) == "none"), F.lit(False))
    parted = F.flatten(F.transform("tokens", lambda x: F.when(loose(x), F.concat(F.array(F.struct(x["plain"].alias("plain"), F.lit(None).cast("string").alias("hit"))), _in_run(x["hit"]))).otherwise(F.array(x))))
    rows = rows.withColumn("tokens", F.when(F.exists("tokens", loose), parted).otherwise(F.col("tokens")))
    named = F.filter(hits("tokens"), lambda x: x.rlike(rf"\A(?:{PATTERNS['name']})\z"))
    rows = rows.withColumn("surnames", F.array_distinct(F.transform(named, lambda x: F.substring_index(x, " ", -1))))
    words = F.flatten(F.transform("tokens", lambda x: F.regexp_extract_all(x["plain"], F.lit(r"\p{Lu}[\p{L}'-]*"), 0)))
    stems = _let(words, lambda w: F.concat(w, F.transform(w, lambda x: F.regexp_replace(x, r"['-]+(?:\p{L}{1,2})?$", ""))))
    rows = rows.withColumn("surnames", F.when(F.size("surnames") > 0, F.array_intersect("surnames", stems)).otherwise(F.col("surnames")))  # such as stand alone
    again = F.concat(F.lit(r"(?<!\p{L}|\p{L}-)(?:"), F.array_join("surnames", "|"), F.lit(r")(?!\p{L}|-\p{L})"))
    bare = F.flatten(F.transform("tokens", lambda x: _searched(x["plain"], again, x["hit"])))
    rows = rows.withColumn("tokens", F.when(F.size("surnames") > 0, bare).otherwise(F.col("tokens")))
    kind = F.when(F.array_contains("surnames", F.col("surface")), "bare").otherwise(_kind(F.col("surface")))
    has = F.coalesce(F.exists(hits("tokens"), lambda x: F.coalesce(_kind(x) != "none", F.lit(False))), F.lit(False))
    rows = saved(rows.select("row", "uid", F.when(~has, F.col("text")).alias("text"), F.when(has, F.col("tokens")).alias("tokens"), F.when(has, F.col("surnames")).alias("surnames")), "searched")
    hit = rows.filter("tokens is not null")
    each = hit.select("uid", "surnames", F.posexplode(hits("tokens")).alias("at", "surface")).filter("surface is not null").withColumn("kind", kind).filter("kind <> 'none'").drop("surnames")
    each = saved(each, "matches")
    mapping = saved(_mapping(each.groupBy("kind", "surface").agg(F.count("*").alias("n")), key), "surrogates")
    shown = F.when(F.col("kind") == "bare", "name").otherwise(F.col("kind"))
    lists = each.join(mapping, ["kind", "surface"]).groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("at", "surrogate"))).alias("new"), F.count("*").alias("n"), F.sort_array(F.collect_set(shown)).alias("kinds"))
    own = F.transform("tokens", lambda x, i: F.concat(x["plain"], F.coalesce(F.try_element_at("new", i), x["hit"], F.lit(""))))
    woven = hit.join(lists, "uid").select("row", F.array_join(own, "").alias("text"), "n", "kinds")
    out = rows.filter("tokens is null").select("row", "text", F.lit(0).cast("long").alias("n"), none.alias("kinds")).union(woven)
    number = {c: f"c{i}" for i, c in enumerate(others)}
    back = [F.col("text").alias(c) if c == text_col else F.col(f"row.{number[c]}").alias(c) for c in order]
    return out.select(*back, *(x.alias(c) for x, c in zip((F.col("n"), F.col("kinds")), added or ())))
