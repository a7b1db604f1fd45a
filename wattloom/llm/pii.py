"""Keyed, type-consistent surrogates for personal data, in DataFrame functions only.

One pattern finds the mentions; `split` and `regexp_extract_all` cut a text into what stays
and what is replaced. A mention consists of parts: a name of its words, an address of its
local part and its domain, all else of itself. Each part has a canonical form, and its
surrogate is drawn from a keyed digest of that, so the same person, domain or number gets
the same surrogate everywhere, however it is written. Laid over the mention, the surrogate
keeps the type, punctuation, case, script, the country of a phone number or bank account,
check digits and, for first names, the gender.

Names are found after a title. Other mentions of such a name's words in the same text are
names too.

The distinct parts of the corpus are drawn for together: where two meet in one surrogate,
or a surrogate is real, the later one is drawn again. Only those few redrawn parts are
joined to the texts; all others are drawn in place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import materialize

_MALE = "Mr|Herr|Monsieur|Señor|Sr"
_FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra"
_STARTS, _ENDS = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_TITLE = rf"{_STARTS}(?:{_MALE}|{_FEMALE}|Dr|Prof)\.? "

#: A run that may be a local part is entered at its start only, or where the last mention ended, and never given back.
#: Longer runs are no address, and longer ones of a key's characters no key: data, say, or a script without spaces.
_LOCAL = r"(?:(?<![\p{L}\p{N}._%+-])|\G)[\p{L}\p{N}._%+-]{1,254}+"
#: kind -> Java pattern; the first that fits a place wins. Time grows with the length of a text, whatever it holds.
PATTERNS = {
    "email": _LOCAL + r"@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,30}\.\p{L}{2,}+",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "iban": rf"{_STARTS}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_ENDS}",
    "secret": rf"{_STARTS}(?:(?:sk|pk|ghp|gho|xox[abp])[-_][A-Za-z0-9_-]{{16,256}}|AKIA[0-9A-Z]{{16}}|[0-9a-f]{{32,256}}|[0-9A-F]{{32,256}}){_ENDS}",
    "ssn": rf"{_STARTS}\d{{3}}-\d{{2}}-\d{{4}}{_ENDS}",
    "phone": rf"\+\d{{1,3}}[ .-]?\(\d{{2,4}}\)[ .-]?\d{{3,4}}[ .-]?\d{{3,4}}{_ENDS}|\+\d{{1,3}}(?:[ .-]?\d{{2,4}}){{2,5}}{_ENDS}|\(\d{{3}}\) ?\d{{3}}[ .-]\d{{4}}{_ENDS}|{_STARTS}\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}}{_ENDS}",
    "card": rf"{_STARTS}(?:\d{{13,19}}|\d{{4}}(?:[ -]\d{{4}}){{3}}){_ENDS}",
    "person": _TITLE + r"\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every mention has a digit or an @, or its text has a title; other texts are not searched further.
_HINT = r"\d|@|" + _TITLE
#: Country calling codes by their first digits; numbers without a + are taken for national ones of code 1.
_COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

#: Alphabets whose characters replace each other.
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
_SYLLABLES = {
    "latin": ["ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "ka", "ke", "ko", "la", "le", "li", "lo", "ma", "me", "mi", "mo", "na", "ne", "ni", "no", "ra", "re", "ri", "ro", "sa", "se", "ta", "vi"],
    "cyrillic": ["ба", "бо", "ва", "ве", "га", "да", "де", "до", "за", "ка", "ко", "ла", "ле", "ли", "ма", "ме", "ми", "мо", "на", "не", "ни", "но", "ра", "ре", "ро", "са", "се", "та", "те", "то", "фе", "ше"],
    "greek": ["βα", "γα", "δα", "δε", "δη", "θα", "θε", "κα", "κε", "κο", "λα", "λε", "λι", "λο", "μα", "με", "μι", "μο", "να", "νε", "νι", "νο", "πα", "πε", "ρα", "ρε", "ρο", "σα", "σε", "τα", "τε", "φι"],
}
_ENDINGS = {"latin": {"m": "n", "f": "a", "x": "l"}, "cyrillic": {"m": "н", "f": "я", "x": "с"}, "greek": {"m": "ς", "f": "α", "x": "ξ"}}

#: Redrawn parts, and texts that hold them, that may be sent to every task.
SMALL_REDRAWN = 100_000
#: After so many drawings a part gets a surrogate out of its format: there are too many of its kind for all to keep it.
MAX_DRAWS = 30
#: Syllables of a name; every four drawings it gets one more, so that names do not run out.
SYLLABLES = 4

_PARTS = "array<struct<kind:string,canonical:string>>"
_MENTIONS = f"array<struct<value:string,kind:string,parts:{_PARTS}>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once and named once in the plan."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _none(type_: str) -> Column:
    return F.array().cast(type_)


def _kind(value: Column) -> Column:
    """The type of a found mention. Patterns are tried in the order in which the search tries them; a bare name fits none."""
    out = None
    for kind, pattern in PATTERNS.items():
        fits = value.rlike(f"^(?:{pattern})$")
        out = F.when(fits, kind) if out is None else out.when(fits, kind)
    return out.otherwise("name")


def _gender(value: Column) -> Column:
    return F.when(value.rlike(rf"^(?:{_FEMALE})(?!\p{{L}})"), "f").when(value.rlike(rf"^(?:{_MALE})(?!\p{{L}})"), "m").otherwise("x")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _check_digit(body: Column) -> Column:
    """The last digit that a number with these first ones must have (Luhn)."""
    worth = lambda c, i: _let(c.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x))
    total = F.aggregate(F.transform(F.split(F.reverse(body), ""), worth), F.lit(0), lambda a, x: a + x)
    return ((10 - total % 10) % 10).cast("string")


def _mod97(account: Column) -> Column:
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(account, ""), F.lit(0), step)


def _is_card(value: Column) -> Column:
    return _let(_digits(value), lambda d: _check_digit(F.substring(d, F.lit(1), F.length(d) - 1)) == F.right(d, F.lit(1)))


def _name_words(value: Column) -> Column:
    return F.split(F.regexp_replace(value, f"^{_TITLE}", ""), " ")


def _titled(text: Column) -> Column:
    return F.when(text.rlike(_TITLE), F.regexp_extract_all(text, F.lit(PATTERNS["person"]), F.lit(0))).otherwise(_none("array<string>"))


def _roles(titled: Column) -> Column:
    """What the words of first and last names are: (word, first_f, first_m, first_x or surname)."""
    two = F.filter(titled, lambda v: F.size(_name_words(v)) == 2)

    def of(value: Column) -> Column:
        words = _name_words(value)
        first = F.struct(F.lower(F.get(words, F.lit(0))).alias("word"), F.concat(F.lit("first_"), _gender(value)).alias("role"))
        return F.array(first, F.struct(F.lower(F.get(words, F.lit(1))).alias("word"), F.lit("surname").alias("role")))

    return F.flatten(F.transform(two, of))


def _pattern(titled: Column) -> Column:
    """All patterns, and the words of the text's own titled names."""
    words = F.array_distinct(F.flatten(F.transform(titled, _name_words)))
    either = F.array_join(F.array_distinct(F.concat(words, F.transform(words, F.upper))), "|")
    return F.concat(F.lit(f"{_ANY}|{_STARTS}(?:"), either, F.lit(")(?: (?:"), either, F.lit(f"))?{_ENDS}"))


def _parts(value: Column, kind: Column, roles: Column) -> Column:
    """(kind, canonical) of what a mention consists of; none if it is left as it is."""
    one = lambda k, c: F.array(F.struct(k.alias("kind"), c.alias("canonical")))
    low = F.lower(value)
    email = F.array(F.struct(kind.alias("kind"), low.alias("canonical")), F.struct(F.lit("domain").alias("kind"), F.split_part(low, F.lit("@"), F.lit(2)).alias("canonical")))

    def word(w: Column, i: Column, n: Column) -> Column:
        own = F.when((kind == "person") & (n == 2) & (i == 1), "surname").when((kind == "person") & (n == 2) & (_gender(value) != "x"), F.concat(F.lit("first_"), _gender(value)))
        known = F.array_min(F.transform(F.filter(roles, lambda r: r["word"] == F.lower(w)), lambda r: r["role"]))
        return F.struct(F.coalesce(own, known, F.lit("surname")).alias("kind"), F.lower(w).alias("canonical"))

    name = _let(_name_words(value), lambda words: F.transform(words, lambda w, i: word(w, i, F.size(words))))
    phone = F.when(value.startswith("+"), _digits(value)).otherwise(F.concat(F.lit("1"), _digits(value)))
    canonical = F.when(kind == "phone", phone).when(kind.isin("card", "ssn"), _digits(value)).when(kind == "iban", F.regexp_replace(value, " ", "")).otherwise(value)
    out = F.when(kind == "email", email).when(kind.isin("person", "name"), name).when((kind == "card") & ~_is_card(value), _none(_PARTS))
    return out.otherwise(one(kind, canonical))


def _with_mentions(docs: DataFrame) -> DataFrame:
    """Adds `_pattern` (null: no titled names) and `_mentions`, all that is found in `text`, in order."""
    text = F.col("text")
    titled = docs.withColumn("_titled", _titled(text))
    named = titled.withColumn("_roles", _roles(F.col("_titled"))).withColumn("_pattern", F.when(F.size("_titled") > 0, _pattern(F.col("_titled"))))
    found = F.when(F.col("_pattern").isNotNull(), F.regexp_extract_all(text, F.col("_pattern"), F.lit(0))).when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)))
    mention = lambda v, k: F.struct(v.alias("value"), k.alias("kind"), _parts(v, k, F.col("_roles")).alias("parts"))
    out = named.withColumn("_found", F.coalesce(found, _none("array<string>")))
    mentions = F.transform("_found", lambda v: _let(_kind(v), lambda k: mention(v, k)))
    return out.withColumn("_mentions", F.coalesce(mentions, _none(_MENTIONS))).drop("_titled", "_roles", "_found")


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, 2 * i + 1, F.lit(2)), 16, 10).cast("int")


def _stream(key: str, kind: Column, canonical: Column, draw: Column) -> Column:
    """Keyed pseudo-random bytes, as hex: one for each character and some more."""
    block = lambda b: F.sha2(F.concat_ws("|", F.lit(key), kind, draw.cast("string"), b.cast("string"), canonical), 256)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.ceil((F.length(canonical) + 40) / 32).cast("int")), block), "")


def _other(c: Column, byte: Column, alphabets: Column) -> Column:
    """A character of the same alphabet; other letters become Latin ones of the same case, all else stays."""
    latin = F.substring(F.lit(_ALPHABETS[1]), byte % 26 + 1, F.lit(1))
    own = F.get(F.filter(alphabets, lambda a: F.instr(a, c) > 0), F.lit(0))
    pick = _let(own, lambda a: F.substring(a, byte % F.length(a) + 1, F.lit(1)))
    return F.when(~c.rlike(r"[\p{L}\p{N}]"), c).otherwise(F.coalesce(pick, F.when(c.rlike(r"\p{Lu}"), F.upper(latin)).when(c.rlike(r"\p{L}"), latin).otherwise(c)))


def _address(stream: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: ((_byte(stream, 2 * i) * 256 + _byte(stream, 2 * i + 1)) % 254 + 1).cast("string")), ".")


def _name(kind: Column, canonical: Column, draw: Column, stream: Column) -> Column:
    """Syllables of the word's script; a first name's end tells its gender."""
    script = F.when(canonical.rlike(r"\p{IsCyrillic}"), "cyrillic").when(canonical.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    by = lambda made: F.when(script == "cyrillic", made("cyrillic")).when(script == "greek", made("greek")).otherwise(made("latin"))
    syllables = by(lambda s: F.array(*map(F.lit, _SYLLABLES[s])))
    word = _let(syllables, lambda all_: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SYLLABLES - 1) + F.floor(draw / 4).cast("int")), lambda i: F.get(all_, _byte(stream, i) % F.size(all_))), ""))
    end = by(lambda s: F.when(kind == "first_m", _ENDINGS[s]["m"]).when(kind == "first_f", _ENDINGS[s]["f"]).when(kind == "first_x", _ENDINGS[s]["x"]).otherwise(""))
    return F.concat(word, end)


def surrogate(key: str, kind: Column, canonical: Column, draw: Column) -> Column:
    """The canonical form of what replaces a part at its `draw`-th drawing."""
    hexadecimal = canonical.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & (kind == "secret")
    alphabets = F.when(hexadecimal & (F.lower(canonical) == canonical), F.array(F.lit("0123456789abcdef"))).when(hexadecimal, F.array(F.lit("0123456789ABCDEF"))).otherwise(F.array(*map(F.lit, _ALPHABETS)))
    keep = F.when(kind == "phone", F.length(F.regexp_extract(canonical, _COUNTRY, 0))).when(kind == "card", 1).when(kind == "iban", 4).when((kind == "secret") & ~hexadecimal, 4).otherwise(0)
    # Of an address the local part, of a domain all but its last label.
    drawn = F.when(kind == "email", F.split_part(canonical, F.lit("@"), F.lit(1))).when(kind == "domain", F.regexp_replace(canonical, r"\.[^.]*$", "")).otherwise(canonical)

    def made(stream: Column) -> Column:
        base = _let(alphabets, lambda a: F.array_join(F.transform(F.split(drawn, ""), lambda c, i: F.when(i < keep, c).otherwise(_other(c, _byte(stream, i), a))), ""))
        spare = _let(F.array(F.lit(_ALPHABETS[1])), lambda a: F.array_join(F.transform(F.sequence(F.lit(1), draw), lambda i: _other(F.lit("a"), _byte(stream, F.length(drawn) + i), a)), ""))
        return _let(base, lambda b: (
            F.when(kind == "ip", _address(stream))
            .when(kind.isin("surname", "first_m", "first_f", "first_x"), _name(kind, canonical, draw, stream))
            .when(kind == "card", _let(F.substring(b, F.lit(1), F.length(b) - 1), lambda x: F.concat(x, _check_digit(x))))
            .when(kind == "iban", F.concat(F.substring(b, 1, 2), F.lpad((98 - _mod97(F.concat(F.substring(b, F.lit(5), F.length(b)), F.substring(b, 1, 2), F.lit("00")))).cast("string"), 2, "0"), F.substring(b, F.lit(5), F.length(b))))
            .when(kind == "domain", F.concat(b, F.when(draw > 2, spare).otherwise(F.lit("")), F.lit("."), F.element_at(F.split(canonical, r"\."), -1)))
            .when((kind == "email") & (draw > 2), F.concat(b, spare))  # short local parts and domains run out
            .otherwise(b)
        ))

    opaque = F.substring(F.sha2(F.concat_ws("|", F.lit(key), kind, canonical).cast("binary"), 256), 1, 24)
    return F.when(draw >= MAX_DRAWS, opaque).otherwise(_let(_stream(key, kind, canonical, draw), made))


def _laid(value: Column, fresh: Column, first: Column | int = 0) -> Column:
    """`fresh` over the letters and digits of `value`, from its character `first` on; what `value` has no room for follows."""
    start = F.struct(F.lit("").alias("out"), (F.lit(first) if isinstance(first, int) else first).cast("int").alias("k"))

    def over(text: Column) -> Column:
        def step(a: Column, c: Column) -> Column:
            new = F.substring(text, a["k"] + 1, F.lit(1))
            cased = F.when(c.rlike(r"\p{Lu}"), F.upper(new)).otherwise(new)
            fits = c.rlike(r"[\p{L}\p{N}]")
            return F.struct(F.concat(a["out"], F.when(fits, cased).otherwise(c)).alias("out"), (a["k"] + fits.cast("int")).alias("k"))

        return F.aggregate(F.split(value, ""), start, step, lambda a: F.concat(a["out"], F.substring(text, a["k"] + 1, F.length(text))))

    return _let(F.regexp_replace(fresh, r"[^\p{L}\p{N}]", ""), over)


def _rendered(m: Column, fresh: Column) -> Column:
    """The mention with its parts' surrogates in place."""
    value, kind = m["value"], m["kind"]
    part = lambda k: F.get(fresh, F.lit(k))
    shown = lambda w, i: _let(F.get(fresh, i), lambda f: F.when((F.upper(w) == w) & (F.length(w) > 1), F.upper(f)).otherwise(F.initcap(f)))
    names = F.concat(F.regexp_extract(value, f"^{_TITLE}", 0), F.array_join(F.transform(_name_words(value), shown), " "))
    # A domain that had to grow is shown as it is, as its dots have moved.
    domain = _let(F.split_part(value, F.lit("@"), F.lit(2)), lambda d: F.when(F.length(d) == F.length(part(1)), _laid(d, part(1))).otherwise(part(1)))
    email = F.concat(_laid(F.split_part(value, F.lit("@"), F.lit(1)), part(0)), F.lit("@"), domain)
    missing = F.when(kind == "phone", F.length(part(0)) - F.length(_digits(value))).otherwise(0)  # a national number lacks the code
    return F.when(F.size(fresh) == 0, value).when(kind == "email", email).when(kind.isin("person", "name"), names).when(kind == "ip", part(0)).otherwise(_laid(value, part(0), missing))


def _redrawn(parts: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, draw) of the parts whose first surrogate was taken or real, from the parts of all texts."""
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entities = parts.groupBy("kind", "canonical").agg(F.count("*").alias("n"))
    # Few rows, but each is costly: dealt out again, so that they do not end in one task.
    drawn = entities.select("kind", "canonical", F.lit(0).alias("draw")).repartition(n, "kind", "canonical")
    domain = F.split_part("canonical", F.lit("@"), F.lit(2))
    for _ in range(MAX_DRAWS):
        made = drawn.withColumn("fresh", surrogate(key, F.col("kind"), F.col("canonical"), F.col("draw")))
        # First and last names share one space; local parts must differ within their domain.
        made = made.withColumn("space", F.when(F.col("kind").rlike("^(?:first_|surname)"), "name").otherwise(F.col("kind")))
        made = made.withColumn("fresh", F.when(F.col("kind") == "email", F.concat("fresh", F.lit("@"), domain)).otherwise(F.col("fresh")))
        drawn = materialize(made, "parts-drawn")
        own = F.struct("kind", "canonical")
        taken = drawn.groupBy("space", "fresh").agg(F.min(own).alias("first"), F.count("*").alias("n")).where("n > 1").select("space", "fresh", "first")
        real = drawn.select("space", F.col("canonical").alias("fresh")).distinct().withColumn("is_real", F.lit(True))
        bad = drawn.join(taken, ["space", "fresh"], "left").join(real, ["space", "fresh"], "left")
        bad = bad.withColumn("bad", F.coalesce(F.col("first") != own, F.lit(False)) | F.coalesce("is_real", F.lit(False)))
        if bad.where("bad").isEmpty():
            break
        drawn = bad.select("kind", "canonical", (F.col("draw") + F.col("bad").cast("int")).alias("draw")).repartition(n, "kind", "canonical")
    else:
        drawn = bad.select("kind", "canonical", F.when(F.col("bad"), MAX_DRAWS).otherwise(F.col("draw")).alias("draw"))
    return drawn.where("draw > 0").select("kind", "canonical", "draw")


def replace_personal_data(docs: DataFrame, key: str) -> DataFrame:
    """`docs` with `text` replaced and two more columns: `n_entities` and `kinds` (array of the types replaced, in order).

    Null texts stay null, with 0 entities; texts without entities, however long, stay as they
    are. All rows, also repeated ones, and all other columns stay; columns called n_entities or
    kinds give way. Numbers of 13 to 19 digits count as cards if their check digit fits. `key`
    is the secret: the same key gives the same surrogates for the same corpus.
    """
    docs = docs.drop("n_entities", "kinds")
    entry = F.concat_ws("|", F.col("part.kind"), F.col("part.canonical"))
    mentions = _with_mentions(docs.select("text")).select(F.explode(F.flatten(F.transform("_mentions", lambda m: m["parts"]))).alias("part"))
    redrawn = materialize(_redrawn(mentions.select("part.kind", "part.canonical"), key), "redrawn")
    n_redrawn = redrawn.count()
    cut = _with_mentions(docs)
    draw = lambda p: F.lit(0)
    if n_redrawn:
        # The few texts that hold a redrawn part, with its number of drawings.
        small = F.broadcast if n_redrawn <= SMALL_REDRAWN else lambda x: x
        mark = F.xxhash64("text")
        own = cut.where("size(_mentions) > 0").select(mark.alias("_mark"), F.explode(F.array_distinct(F.flatten(F.transform("_mentions", lambda m: m["parts"])))).alias("part"))
        draws = own.select("_mark", "part.kind", "part.canonical", entry.alias("entry")).distinct().join(small(redrawn), ["kind", "canonical"])
        draws = materialize(draws.groupBy("_mark").agg(F.map_from_entries(F.collect_list(F.struct("entry", "draw"))).alias("_draws")), "draws")
        few = draws.count() <= SMALL_REDRAWN
        cut = cut.withColumn("_mark", mark).join(F.broadcast(draws) if few else draws, "_mark", "left").drop("_mark")
        draw = lambda p: F.coalesce(F.try_element_at("_draws", F.concat_ws("|", p["kind"], p["canonical"])), F.lit(0))
    fresh = lambda m: F.transform(m["parts"], lambda p: _let(draw(p), lambda d: surrogate(key, p["kind"], p["canonical"], d)))
    out = cut.withColumn("_fresh", F.transform("_mentions", lambda m: _let(fresh(m), lambda f: _rendered(m, f))))
    kept = F.when(F.col("_pattern").isNotNull(), F.split("text", F.col("_pattern"), -1)).otherwise(F.split("text", F.lit(_ANY), -1))
    joined = F.array_join(F.transform(kept, lambda s, i: F.concat(s, F.coalesce(F.get("_fresh", i), F.lit("")))), "")
    kinds = F.transform(F.filter("_mentions", lambda m: F.size(m["parts"]) > 0), lambda m: m["kind"])
    out = out.withColumn("kinds", kinds).withColumn("n_entities", F.size("kinds").cast("long")).withColumn("text", F.when(F.size("_mentions") > 0, joined).otherwise(F.col("text")))
    return out.select(*docs.columns, "n_entities", "kinds")
