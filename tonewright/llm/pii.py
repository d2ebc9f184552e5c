"""Personal data and secrets replaced by keyed surrogates, with DataFrame functions only.

Detected: e-mail addresses, IPv4 and IPv6 addresses, phone numbers, 16-digit card numbers,
nnn-nn-nnnn numbers, long hexadecimal secrets, access keys of usual shapes, and names of one
or two words behind a form of address. A name without one is left alone.

Each different entity gets one surrogate from a keyed hash, everywhere in the corpus, so
that coreference stays. Spellings of one entity (case, separators) share the surrogate
and keep their own spelling. A name's family and given names are entities of their own, so
that "Mr. Lee" and "Mr. John Lee" still share a family name; a given name behind a form of
address without gender (Dr., Prof.) takes the gender that the corpus gives it elsewhere, if
that is only one. Letters become letters of the same script and case, digits digits; the
country code of a phone number, the first digit of a card number and its Luhn check, the
top-level domain, a key's prefix and the grouping stay as they are. Surrogate names are made
of syllables, by script and gender.

Collision checks run over the whole corpus in rounds: a surrogate is refused if another
entity was given it, if two entities ask for it (the smaller one keeps it), or if it is
itself an entity of the corpus. Refused entities ask again with another hash. Surrogate
names grow by a syllable with each round, addresses and numbers by a digit with each round
after the first LENGTHEN_AFTER, so that the rounds end however many entities there are; only
IP addresses keep their space, of which entities must not fill half.

The patterns read a text once from left to right: none of them goes back over a long run.
Two passes read the texts; only rows with entities are shuffled, and the mentions of an
entity that very many rows hold are dealt over many tasks. Texts: null stays null and
empty stays empty; very long texts are read whole; repeated rows are treated alike. An
empty table gives an empty table. Other columns pass through, whatever their names are;
`found_col` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, spread_join

# Patterns in the order in which they are tried.
EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)++"
KEY_PREFIX = r"(?:AKIA|ASIA|gh[pousr]_|sk[_\-](?:live|test)[_\-]|xox[abp]-)"
KEY = r"(?<![0-9A-Za-z])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk[_\-](?:live|test)[_\-][0-9A-Za-z]{16,64}|xox[abp]-[0-9A-Za-z\-]{10,72})(?![0-9A-Za-z])"
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)"
IPV6 = r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])"
PHONE = r"(?<!\d)(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)|\+\d{1,3}[ .\-]\d{2,4}[ .\-]\d{3}[ .\-]?\d{4}(?!\d)|(?<![\d.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?!\d|[.\-]\d)"
CARD = r"(?<!\d)(?:\d{4}[ \-]?){3}\d{4}(?!\d)"
NATIONAL = r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"
MALE = "Mr|Herr|Monsieur|Señor|Господин"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Señora|Госпожа"
NEUTRAL = "Dr|Prof|Professor|Доктор"
WORD = r"\p{Lu}[\p{L}'\-]++"
ADDRESS = rf"(?:{FEMALE}|{MALE}|{NEUTRAL})\.? "
NAME = rf"(?<!\p{{L}}){ADDRESS}{WORD}(?: {WORD})?"
ANY = "|".join([EMAIL, KEY, SECRET, IPV6, IPV4, PHONE, CARD, NATIONAL, NAME])
#: Texts without any of these hold no entity.
HINT = rf"[0-9@]|::|{ADDRESS}|{KEY_PREFIX}"
# Letters by script, and syllables of surrogate names by script.
LETTERS = [("[0-9]", "0123456789"), ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("[ß-öø-ÿ]", "àâäéèêëíîïñóôöúûüç"), ("[а-яё]", "абвгдежзиклмнопрстуфхцчшэюя"), ("[α-ω]", "αβγδεζηθικλμνξοπρστυφχψω"), (r"[一-鿿]", "山水木火土日月石田竹")]
SYLLABLES = {
    "latin": {
        "start": "ba be bo bra ca co da do dra fa fe ga gra ha he ja ka ke la lo ma me na no pa pe ra ro sa ste ta tre va we za",
        "middle": "bi co da di fa ga la li lo ma mi na ne ni ra ri ro sa se ta te va vi zu",
        "family": "bach berg dell feld ford hauer ker ler ley man mer nik rek sen ser son ston ton well wick",
        "f": "bela dina lia line lotta mara mina nelle nia nora rina rosa tine vera",
        "m": "bert dan dolf don gor lan mir nek nold rik ron sil tin vin",
        "n": "bin del fie kim lin lou min ren rin sey tony win",
    },
    "cyrillic": {
        "start": "ба бе бо ва ве во га го да до жа за зо ка ко ла ло ма ме на но па по ра ро са со та то фе ха че ша",
        "middle": "ба ви га да ди ка ле ли ло ма ми на не ни ра ри ро са та ти",
        "family": "бин вец вич дько ев енко ин кас ков лык мко нин ров руль сюк тин хов чук шко як",
        "f": "вия дина ла лия мила на ния рина са сия та фья",
        "m": "ван вид дан дрей илл лав лип мен мир рил тан тон",
        "n": "бин ель ким лель мин рин си тони",
    },
    "greek": {"start": "αλ βα γε δη ελ θε κα λε μα νι πα ρο σω τα φι", "middle": "βα γι δα κα λι μα να ρι σο τα", "family": "δης κης λος νης πουλος ρας σης τος", "f": "δα θεια λια να ρα σια", "m": "δης λος νος ρης σης της", "n": "λις νις ρι σι"},
}
LENGTHEN_AFTER = 8


def _value(h: Column, i: Column, of: int) -> Column:
    """The i-th number under `of` that a hexadecimal hash gives."""
    at = (i.cast("int") % 31) * 4 + 1
    return (F.conv(F.substr(h, at, F.lit(4)), 16, 10).cast("int") % of).cast("int")


def _pick(h: Column, i: Column, words: str) -> Column:
    choice = words.split(" ")
    return F.element_at(F.array(*map(F.lit, choice)), _value(h, i, len(choice)) + 1)


def _letters(text: Column, h: Column) -> Column:
    """Each letter or digit becomes another of its kind."""

    def one(c: Column, i: Column) -> Column:
        out = None
        for pattern, alphabet in LETTERS:
            new = F.substr(F.lit(alphabet), _value(h, i, len(alphabet)) + 1, F.lit(1))
            out = F.when(c.rlike(f"^{pattern}$"), new) if out is None else out.when(c.rlike(f"^{pattern}$"), new)
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _digits(h: Column, size: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), size), lambda i: _value(h, i, 10).cast("string")), "")


def luhn(digits: Column) -> Column:
    """Sum of the Luhn check over a string of digits; 0 modulo 10 where it holds."""
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(values, F.lit(0), lambda s, v: (s + v - F.when(v > 9, 9).otherwise(0)).cast("int"))


def kind_of(surface: Column) -> Column:
    whole = lambda p: surface.rlike(f"^(?:{p})$")
    out = F.when(surface.contains("@"), "email").when(surface.rlike(f"^{KEY_PREFIX}"), "key").when(surface.rlike("^(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})$"), "secret")
    out = out.when(whole(r"(?:\d{1,3}\.){3}\d{1,3}"), "ipv4").when(surface.rlike("^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), "ipv6")
    out = out.when(whole(r"(?:\d{4}[ \-]?){3}\d{4}"), "card").when(whole(r"\d{3}-\d{2}-\d{4}"), "national")
    return out.when(surface.rlike(r"^[+(\d]"), "phone").otherwise("name")


def canonical(kind: Column, surface: Column) -> Column:
    """What the spellings of one entity have in common."""
    country = F.when(surface.startswith("+"), F.concat(F.regexp_extract(surface, r"^\+(\d{1,3})", 1), F.lit("+"))).otherwise("")
    number = F.regexp_replace(F.regexp_replace(surface, r"^\+\d{1,3}", ""), r"\D", "")
    out = F.when(kind.isin("email", "secret", "ipv6"), F.lower(surface)).when(kind.isin("ipv4", "key"), surface)
    return out.when(kind == "phone", F.concat(country, number)).otherwise(F.regexp_replace(surface, r"\D", ""))


def parts_of(kind: Column, surface: Column) -> Column:
    """The entities of a spelling: (place, kind, gender, entity), two of them for a name of two words."""
    words = F.split(F.regexp_replace(surface, f"^{ADDRESS}", ""), " ")
    gender = F.when(surface.rlike(rf"^(?:{FEMALE})\b"), "f").when(surface.rlike(rf"^(?:{MALE})\b"), "m").otherwise("n")
    part = lambda place, k, g, x: F.struct(F.lit(place).alias("place"), k.alias("kind"), g.alias("gender"), x.alias("entity"))
    given, family = part(0, F.lit("given"), gender, F.lower(F.element_at(words, 1))), part(1, F.lit("family"), F.lit(""), F.lower(F.element_at(words, -1)))
    named = F.when(F.size(words) > 1, F.array(given, family)).otherwise(F.array(family))
    return F.when(kind == "name", named).otherwise(F.array(part(0, kind, F.lit(""), canonical(kind, surface))))


def surrogate_name(kind: Column, entity: Column, h: Column, attempt: Column) -> Column:
    """Syllables in the entity's script, with the ending of a family name or of a given name's gender."""
    more = F.sequence(F.lit(3), attempt + 3)
    out = latin = None
    for script, parts in SYLLABLES.items():
        end = F.when(kind == "family", _pick(h, F.lit(1), parts["family"]))
        for gender in "fmn":
            end = end.when(kind == f"given:{gender}", _pick(h, F.lit(1), parts[gender]))
        middle = parts["middle"]
        made = F.concat(_pick(h, F.lit(0), parts["start"]), F.array_join(F.transform(more, lambda i: _pick(h, i, middle)), ""), end)  # noqa: B023
        there = entity.rlike(rf"\p{{Is{script.capitalize()}}}")
        out = F.when(there, made) if out is None else out.when(there, made)
        latin = made if latin is None else latin
    return out.otherwise(latin)


def proposal(kind: Column, entity: Column, key: str, attempt: Column) -> Column:
    """A surrogate in canonical form; another attempt gives another one."""
    h = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, entity, attempt.cast("string")), 512)
    more = F.greatest(attempt - LENGTHEN_AFTER, F.lit(0))
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    top = F.substring_index(domain, ".", -1)
    site = F.substr(domain, F.lit(1), F.length(domain) - F.length(top))
    of_site = F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit("domain"), domain), 512)
    email = F.concat(_letters(local, h), F.when(more > 0, _digits(F.reverse(h), more)).otherwise(""), F.lit("@"), _letters(site, of_site), top)
    octets = F.concat_ws(".", *[(_value(h, F.lit(i), 254) + 1).cast("string") for i in range(4)])
    code, number = F.regexp_extract(entity, r"^(\d+\+)?", 0), F.regexp_replace(entity, r"^\d+\+", "")
    phone = F.concat(code, _digits(h, F.length(number) + more))
    body = F.concat(F.substr(entity, F.lit(1), F.lit(1)), _digits(h, F.lit(14) + more))
    check = ((10 - luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    card = F.concat(body, F.when(luhn(entity) % 10 == 0, check).otherwise(_value(h, F.lit(20), 10).cast("string")))
    hexadecimal = lambda c, i: F.lower(F.conv(_value(h, i, 16).cast("string"), 10, 16))
    secret = F.array_join(F.transform(F.split(entity, ""), hexadecimal), "")
    group = lambda g, i: F.when(g == "", g).otherwise(F.substr(h, i * 5 + 1, F.least(F.length(g) + more, F.lit(4))))
    ipv6 = F.array_join(F.transform(F.split(entity, ":"), group), ":")
    prefix = F.regexp_extract(entity, f"^{KEY_PREFIX}", 0)
    access = F.concat(prefix, _letters(F.regexp_replace(entity, f"^{KEY_PREFIX}", ""), h))
    out = F.when(kind == "email", email).when(kind == "ipv4", octets).when(kind == "ipv6", ipv6).when(kind == "phone", phone).when(kind == "card", card)
    out = out.when(kind == "secret", secret).when(kind == "key", access).when((kind == "family") | kind.startswith("given:"), surrogate_name(kind, entity, h, attempt))
    return out.otherwise(_digits(h, F.length(entity) + more))


def cased(word: Column, surrogate: Column) -> Column:
    """A name in the case of the word that it stands for."""
    return F.when((word == F.upper(word)) & (F.length(word) > 1), F.upper(surrogate)).otherwise(F.concat(F.upper(F.substring(surrogate, 1, 1)), F.substring(surrogate, 2, 1 << 20)))


def spelled(kind: Column, surface: Column, surrogates: Column) -> Column:
    """The surrogates of a spelling's entities, as this occurrence spells them."""
    surrogate = F.element_at(surrogates, 1)
    code = F.regexp_extract(surrogate, r"^(\d+)\+", 1)
    number = F.concat(code, F.regexp_replace(surrogate, r"^\d+\+", ""))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"))

    def fill(done: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        new = F.concat(done["out"], F.when(digit, F.substr(number, done["used"] + 1, F.lit(1))).otherwise(c))
        return F.struct(new.alias("out"), (done["used"] + digit.cast("int")).alias("used"))

    filled = F.aggregate(F.split(surface, ""), start, fill)
    grouped = F.concat(filled["out"], F.substr(number, filled["used"] + 1, F.length(number)))

    def one(c: Column, i: Column) -> Column:
        new = F.substr(surrogate, (i + 1).cast("int"), F.lit(1))
        return F.when((c == F.upper(c)) & (c != F.lower(c)), F.upper(new)).otherwise(new)

    letters = F.when(F.length(surface) == F.length(surrogate), F.array_join(F.transform(F.split(surface, ""), one), "")).when(surface == F.upper(surface), F.upper(surrogate)).otherwise(surrogate)
    address = F.regexp_extract(surface, f"^{ADDRESS}", 0)
    words = F.split(F.regexp_replace(surface, f"^{ADDRESS}", ""), " ")
    name = F.concat(address, F.array_join(F.zip_with(words, surrogates, cased), " "))
    return F.when(kind.isin("email", "secret", "ipv6"), letters).when(kind.isin("ipv4", "key"), surrogate).when(kind == "name", name).otherwise(grouped)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate) of distinct (kind, entity), without collisions."""
    entities = checkpointed(entities)
    taken = entities.select("kind", F.col("entity").alias("surrogate"))
    open_, done, attempt = entities, None, 0
    while True:
        asked = open_.withColumn("surrogate", proposal(F.col("kind"), F.col("entity"), key, F.lit(attempt)))
        asked = checkpointed(asked.withColumn("surrogate", F.coalesce("surrogate", F.lit(""))))
        first = asked.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity"))
        given = checkpointed(first.join(taken, ["kind", "surrogate"], "left_anti").select("kind", "entity", "surrogate"))
        done = given if done is None else done.unionByName(given)
        open_ = checkpointed(open_.join(given.select("kind", "entity"), ["kind", "entity"], "left_anti"))
        if not open_.limit(1).count():
            return done
        taken = taken.unionByName(given.select("kind", "surrogate"))
        attempt += 1


def entities_of(surfaces: DataFrame) -> DataFrame:
    """(surface, spelling, place, kind, entity) of distinct spellings; given names carry their gender in `kind`."""
    pieces = surfaces.withColumn("spelling", kind_of(F.col("surface")))
    pieces = checkpointed(pieces.select("surface", "spelling", F.inline(parts_of(F.col("spelling"), F.col("surface")))))
    told = pieces.where("kind = 'given' and gender <> 'n'").groupBy("entity").agg(F.min("gender").alias("low"), F.max("gender").alias("high"))
    known = pieces.where("kind = 'given'").join(told, "entity", "left")
    gender = F.when((F.col("gender") == "n") & (F.col("low") == F.col("high")), F.col("low")).otherwise(F.col("gender"))
    given = known.select("surface", "spelling", "place", F.concat(F.lit("given:"), gender).alias("kind"), "entity")
    return pieces.where("kind <> 'given'").select("surface", "spelling", "place", "kind", "entity").unionByName(given)


def replace(df: DataFrame, key: str, text_col: str = "text", found_col: str = "n_entities") -> DataFrame:
    """df with entities in the text replaced, and their number added."""
    kept = df.drop(found_col) if found_col != text_col else df
    rows = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("_row"))
    text = F.col("_row")[text_col]
    some = F.coalesce(text.rlike(HINT) & text.rlike(ANY), F.lit(False))

    def back(new: Column, n: Column) -> list[Column]:
        own = [new.alias(c) if c == text_col and c != found_col else F.col("_row")[c].alias(c) for c in kept.columns if c != found_col]
        return [*own, n.cast("long").alias(found_col)]

    hits = rows.where(some).select("_row", F.regexp_extract_all(text, F.lit(ANY), 0).alias("_found"))
    hits = checkpointed(hits.withColumn("_key", F.monotonically_increasing_id()))
    seen = hits.select("_key", F.posexplode("_found").alias("_at", "surface"))
    pieces = checkpointed(entities_of(seen.select("surface").distinct()))
    mapped = pieces.join(surrogates(pieces.select("kind", "entity").distinct(), key), ["kind", "entity"])
    mapped = mapped.groupBy("surface", "spelling").agg(F.array_sort(F.collect_list(F.struct("place", "surrogate")))["surrogate"].alias("_parts"))
    mapped = checkpointed(mapped.select("surface", spelled(F.col("spelling"), F.col("surface"), F.col("_parts")).alias("_new")))
    new = spread_join(seen, mapped, "surface", F.col("_key"))
    new = new.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_at", "_new")))["_new"].alias("_all"))
    parts = F.split(text, ANY, -1)
    put = F.concat(F.element_at(parts, 1), F.array_join(F.transform("_all", lambda x, i: F.concat(x, F.element_at(parts, i + 2))), ""))
    return rows.where(~some).select(*back(text, F.lit(0))).unionByName(hits.join(new, "_key").select(*back(put, F.size("_found"))))
