"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations, in DataFrame functions only.

Method. One pattern finds candidates; a candidate is validated by its kind (payment cards and account numbers by their check digits,
social security numbers and addresses of the internet by their ranges, dates by the calendar) and left alone where that fails. A valid
number or date is taken as a pair of residues and put through a keyed Feistel network with modular addition, which permutes the
values of its format: card numbers keep length, first digit, grouping and a right check digit; account numbers keep country, letters,
grouping and right check digits; phone numbers keep country code and punctuation; dates stay dates within their quarter of a
century (1900 to 1924 and so on to 2075 to 2099), in their own notation. Equal values under one key get equal pseudonyms in every
document, and different values of one notation different ones. Mail addresses and secrets aren't numbers; they get a keyed digest
in their own format, and keys that are known by their first letters keep those.

Null texts stay null, empty texts stay empty, texts without candidates pass unchanged; each row stands alone, so ties, repeated
rows and rows without doc_id are nothing special. Other columns pass through; n_private is replaced if the input has it. Texts and
candidates of any length are handled whole: what repeats without a bound in a pattern is a class of characters or possessive, which
the matcher runs through without recursion. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: A card: 13 to 19 digits together, in groups of four (the last of one to seven) or of 4, 6 and 5, with one kind of separator.
CARD = r"(?<![\p{L}\p{N}.+-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\g[0-9]{4}\g[0-9]{1,7})(?![\p{L}\p{N}])"
#: All labels behind the sign if the last is of letters; else as many as a name can have (127) up to one of letters.
MAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++(?<=\.\p{L}{2,63})|[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+){0,125}\.\p{L}{2,})"
SECRET = r"(?<![\p{L}\p{N}_-])(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)(?:\s?[=:]\s?)[\"']?[A-Za-z0-9+/_.=-]{8,}"
#: The first letters of keys that services give out.
KEYS = {
    "AKIA": "[0-9A-Z]{16}",
    "ASIA": "[0-9A-Z]{16}",
    "AIza": "[0-9A-Za-z_-]{35}",
    "ghp_": "[0-9A-Za-z]{36}",
    "gho_": "[0-9A-Za-z]{36}",
    "ghs_": "[0-9A-Za-z]{36}",
    "github_pat_": "[0-9A-Za-z_]{22,}",
    "glpat-": "[0-9A-Za-z_-]{20,}",
    "hf_": "[0-9A-Za-z]{30,}",
    "sk-": "[0-9A-Za-z_-]{20,}",
    "sk_live_": "[0-9A-Za-z]{16,}",
    "xoxb-": "[0-9A-Za-z-]{20,}",
    "xoxp-": "[0-9A-Za-z-]{20,}",
}
BARE = r"(?<![\p{L}\p{N}_-])(?:" + "|".join(f"{k}{v}" for k, v in KEYS.items()) + r")(?![\p{L}\p{N}_-])"
NAMED = "^(" + "|".join(KEYS) + ")"
#: Country, check digits, then 11 to 30 letters and digits, together or in groups of four.
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{11,30}|(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,4}))(?![\p{L}\p{N}])"
#: Eight groups, or fewer with a double colon after a first group of four digits.
IP6 = r"(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\p{L}\p{N}:])"
TEN = r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
PHONE = rf"(?<![\p{{L}}\p{{N}}+(]){TEN}(?![\p{{L}}\p{{N}}])"
#: A plus and 7 to 15 digits in any grouping.
ABROAD = r"(?<![\p{L}\p{N}+])\+[0-9](?:[ .()/-]{0,2}[0-9]){6,14}(?![\p{L}\p{N}])"
#: Country codes of one and two digits; all others have three.
COUNTRY = "^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
IP = r"(?<![\p{L}\p{N}.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\p{L}\p{N}]|\.[0-9])"
SSN = r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])"
DATE = r"(?<![\p{L}\p{N}/.-])(?:(?:19|20)[0-9]{2}-[0-9]{1,2}-[0-9]{1,2}(?:(?=T[0-9])|(?![\p{L}\p{N}/-]))|[0-9]{1,2}[/.][0-9]{1,2}[/.](?:19|20)[0-9]{2}(?![\p{L}\p{N}/-]))"
CARD = CARD.replace(r"([ -])[0-9]{4}\g[0-9]{4}\g", r"(?: [0-9]{4} [0-9]{4} |-[0-9]{4}-[0-9]{4}-)").replace("|[0-9]{4}(?:", "|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5}|[0-9]{4}(?:")
#: Most specific first: where two match at one place, the first wins.
PATTERN = "|".join((MAIL, SECRET, BARE, IBAN, IP6, SSN, DATE, IP, PHONE, ABROAD, CARD))


def feistel(left: Column, right: Column, m_left: Column | int, m_right: Column | int, key: str, kind: str) -> Column:
    """struct<l, r>: a keyed permutation of the pairs with 0 <= left < m_left and 0 <= right < m_right. Rounds in turn add, to one half, a
    digest of the other half under key, kind and round."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    m_left, m_right = lit(m_left).cast("long"), lit(m_right).cast("long")

    def digest(i: Column, half: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), half.cast("string")), 256), 1, 14), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        return F.struct(
            F.when(i % 2 == 0, F.pmod(s["l"] + digest(i, s["r"]), m_left)).otherwise(s["l"]).alias("l"),
            F.when(i % 2 == 1, F.pmod(s["r"] + digest(i, s["l"]), m_right)).otherwise(s["r"]).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _lay(value: Column, digits: Column) -> Column:
    """value with its digits replaced, one after another, by those of `digits`."""
    zero = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))

    def step(a: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), F.struct(F.concat(a["s"], F.substring(digits, a["i"], F.lit(1))).alias("s"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["i"].alias("i")))

    return F.aggregate(F.split(value, ""), zero, step)["s"]


def _int(text: Column, at: Column | int, n: Column | int) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.substring(text, lit(at), lit(n)).cast("long")


def _padded(number: Column, width: Column | int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def luhn_sum(digits: Column) -> Column:
    """The weighted digit sum in which the last digit counts once; a valid number's is divisible by ten."""
    terms = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x)


def card(value: Column, key: str) -> Column:
    digits = _digits(value)
    n = F.length(digits)
    low = F.floor((n - 2) / 2).cast("int")  # digits of the left half; first and check digit aren't permuted
    high = n - 2 - low
    ten = lambda k: F.pow(F.lit(10), k).cast("long")

    def out(pair: Column) -> Column:
        body = F.concat(F.substring(digits, 1, 1), F.lpad(pair["l"].cast("string"), low, "0"), F.lpad(pair["r"].cast("string"), high, "0"))
        return F.concat(body, F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))

    pair = F.array(feistel(_int(digits, 2, low), _int(digits, low + 2, high), ten(low), ten(high), key, "card"))
    return F.when(luhn_sum(digits) % 10 == 0, _lay(value, F.element_at(F.transform(pair, out), 1))).otherwise(value)


def phone(value: Column, key: str) -> Column:
    digits = _digits(value)
    n = F.length(digits)
    kept = F.when(value.rlike(f"^{TEN}$"), n - 10).otherwise(F.length(F.regexp_extract(digits, COUNTRY, 0)))
    low = F.floor((n - kept) / 2).cast("int")
    high = n - kept - low
    ten = lambda k: F.pow(F.lit(10), k).cast("long")
    pair = F.array(feistel(_int(digits, kept + 1, low), _int(digits, kept + low + 1, high), ten(low), ten(high), key, "phone"))
    new = F.transform(pair, lambda p: F.concat(F.substring(digits, F.lit(1), kept), _padded(p["l"], low), _padded(p["r"], high)))
    return _lay(value, F.element_at(new, 1))


def ip(value: Column, key: str) -> Column:
    part = F.split(value, r"\.")
    octet = [part[i].cast("long") for i in range(4)]
    valid = (octet[0] < 256) & (octet[1] < 256) & (octet[2] < 256) & (octet[3] < 256)
    pair = F.array(feistel(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], 65_536, 65_536, key, "ip"))
    byte = lambda x, y: (F.floor(x / 256) if y else F.pmod(x, F.lit(256))).cast("string")
    new = F.transform(pair, lambda p: F.concat_ws(".", byte(p["l"], True), byte(p["l"], False), byte(p["r"], True), byte(p["r"], False)))
    return F.when(valid, F.element_at(new, 1)).otherwise(value)


def ssn(value: Column, key: str) -> Column:
    """Areas are 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = _int(value, 1, 3), _int(value, 5, 2), _int(value, 8, 4)
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area < 666, area - 1).otherwise(area - 2)
    pair = F.array(feistel(place, (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn"))
    new = F.transform(pair, lambda p: F.concat_ws("-", _padded(F.when(p["l"] < 665, p["l"] + 1).otherwise(p["l"] + 2), 3), _padded(F.floor(p["r"] / 9999) + 1, 2), _padded(F.pmod(p["r"], F.lit(9999)) + 1, 4)))
    return F.when(valid, F.element_at(new, 1)).otherwise(value)


def date(value: Column, key: str) -> Column:
    """yyyy-mm-dd, mm/dd/yyyy and dd.mm.yyyy (dd/mm/yyyy where the first can't be a month), and the same without leading zeros. A quarter
    of a century has 9131 = 23 * 397 days, that from 2000 on 9132 = 12 * 761."""
    notes = ["yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "yyyy-M-d", "M/d/yyyy", "d/M/yyyy", "d.M.yyyy"]
    shape = [r"^\d{4}-\d\d-\d\d$", r"^\d\d/\d\d/", r"^\d\d/\d\d/", r"^\d\d\.\d\d\."]
    shape += [r"^\d{4}-(?!\d\d-\d\d$)", r"^(?!\d\d/\d\d/)\d+/", r"^(?!\d\d/\d\d/)\d+/", r"^(?!\d\d\.\d\d\.)\d+\."]
    day = F.array(*(F.when(value.rlike(s), F.try_to_timestamp(value, F.lit(n)).cast("date")) for s, n in zip(shape, notes)))
    which = F.array_position(F.transform(day, lambda d: d.isNotNull()), True)
    own = F.element_at(day, which.cast("int"))
    first = F.make_date((F.floor(F.year(own) / 25) * 25).cast("int"), F.lit(1), F.lit(1))
    place, leap = F.date_diff(own, first), F.year(first) == 2000
    left, right = F.when(leap, 12).otherwise(23), F.when(leap, 761).otherwise(397)
    pair = F.array(feistel(F.floor(place / right), F.pmod(place, right), left, right, key, "date"))
    new = F.element_at(F.transform(pair, lambda p: F.date_add(first, (p["l"] * right + p["r"]).cast("int"))), 1)
    out = F.coalesce(*(F.when(which == i + 1, F.date_format(new, n)) for i, n in enumerate(notes)))
    return F.when(which > 0, out).otherwise(value)


def _mod97(text: Column) -> Column:
    """The remainder by 97 of letters and digits read as one number, A as 10 and so on."""
    number = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(F.pmod(a * F.when(c.between("0", "9"), 10).otherwise(100) + number(c), F.lit(97))).cast("int"))


def iban(value: Column, key: str) -> Column:
    """Country and letters stay, the digits of the account are permuted, and the check digits are made right again."""
    packed = F.replace(value, F.lit(" "), F.lit(""))
    account, country = F.substring(packed, F.lit(5), F.length(packed)), F.substring(packed, 1, 2)
    valid = _mod97(F.concat(account, F.substring(packed, 1, 4))) == 1
    digits = _digits(account)
    low = F.floor(F.length(digits) / 2).cast("int")
    high = F.length(digits) - low
    ten = lambda k: F.pow(F.lit(10), k).cast("long")
    pair = F.array(feistel(F.coalesce(_int(digits, 1, low), F.lit(0)), F.coalesce(_int(digits, low + 1, high), F.lit(0)), ten(low), ten(high), key, "iban"))

    def out(p: Column) -> Column:
        new = _lay(account, F.concat(F.when(low > 0, _padded(p["l"], low)).otherwise(""), F.when(high > 0, _padded(p["r"], high)).otherwise("")))
        return F.concat(country, _padded(98 - _mod97(F.concat(new, country, F.lit("00"))), 2), new)

    grouped = F.transform(pair, lambda p: F.when(value.contains(" "), F.regexp_replace(out(p), "(.{4})(?=.)", "$1 ")).otherwise(out(p)))
    return F.when(valid, F.element_at(grouped, 1)).otherwise(value)


def ip6(value: Column, key: str) -> Column:
    """Written out in eight groups of four digits. Network and host are permuted each by itself, so addresses of one network stay in one."""
    halves = F.split(value, "::")
    groups = lambda h: F.filter(F.split(F.coalesce(h, F.lit("")), ":"), lambda g: g != "")
    left, right = groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1)))
    missing = 8 - F.size(left) - F.size(right)
    full = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
    number = F.transform(full, lambda g: F.conv(g, 16, 10).cast("long"))
    valid = (F.size(full) == 8) & F.when(value.contains("::"), missing > 0).otherwise(missing == 0)
    word = lambda i: F.get(number, F.lit(i)) * 65_536 + F.get(number, F.lit(i + 1))
    pairs = F.array(feistel(word(0), word(2), 1 << 32, 1 << 32, key, "network"), feistel(word(4), word(6), 1 << 32, 1 << 32, key, "host"))
    hexed = lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))
    new = F.array_join(F.transform(pairs, lambda p: F.concat(hexed(p["l"]), hexed(p["r"]))), "")
    return F.when(valid, F.regexp_replace(new, "(.{4})(?=.)", "$1:")).otherwise(value)


def mail(value: Column, key: str) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{key}|mail|"), F.lower(value)), 256)
    return F.concat(F.lit("user."), F.substring(digest, 1, 12), F.lit("@mail."), F.substring(digest, 13, 8), F.lit(".example"))


def secret(value: Column, key: str) -> Column:
    """The name and the sign stay; what follows becomes as many hexadecimal digits."""
    name = F.regexp_extract(value, r"^([A-Za-z_-]+\s?[=:]\s?[\"']?)", 1)
    rest = F.substring(value, F.length(name) + 1, F.length(value))
    digest = F.sha2(F.concat(F.lit(f"{key}|secret|"), rest), 512)
    return F.concat(name, F.substring(F.repeat(digest, F.ceil(F.length(rest) / 128).cast("int")), F.lit(1), F.length(rest)))


def bare(value: Column, key: str) -> Column:
    """The first letters stay; what follows becomes as many hexadecimal digits, capitals where it had no small letters."""
    name = F.regexp_extract(value, NAMED, 1)
    rest = F.substring(value, F.length(name) + 1, F.length(value))
    digest = F.sha2(F.concat(F.lit(f"{key}|secret|"), rest), 512)
    new = F.substring(F.repeat(digest, F.ceil(F.length(rest) / 128).cast("int")), F.lit(1), F.length(rest))
    return F.concat(name, F.when(rest == F.upper(rest), F.upper(new)).otherwise(new))


def pseudonym(value: Column, key: str) -> Column:
    """What stands for a candidate; the candidate itself where it isn't valid."""
    return (
        F.when(value.contains("@"), mail(value, key))
        .when(value.rlike(f"^(?:{BARE})$"), bare(value, key))
        .when(value.rlike(f"^(?:{IBAN})$"), iban(value, key))
        .when(value.rlike(f"^(?:{IP6})$"), ip6(value, key))
        .when(value.rlike("^[A-Za-z]"), secret(value, key))
        .when(value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), ssn(value, key))
        .when(value.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$|^[0-9]{1,2}([/.])[0-9]{1,2}\1[0-9]{4}$"), date(value, key))
        .when(value.rlike(r"^[0-9]+(\.[0-9]+){3}$"), ip(value, key))
        .when(value.rlike(r"^([0-9]{13,19}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]+|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$"), card(value, key))
        .when(value.rlike(r"^[+(]|^[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$"), phone(value, key))
        .otherwise(value)
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs (text, any others). Returns its columns, text with pseudonyms in place of personal data, and n_private long: how many values
    were replaced. The text is cut at the candidates and put together again around their pseudonyms, so that nothing that was put
    in is looked at again."""
    rest = [c for c in docs.columns if c not in ("text", "n_private")]
    own = docs.select(*([F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest")] if rest else []), F.col("text").cast("string"))
    own = own.withColumn("found", F.when(F.col("text").rlike(PATTERN), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))))
    own = own.withColumn("new", F.transform("found", lambda v: pseudonym(v, key)))
    between = F.split("text", PATTERN, -1)
    joined = F.array_join(F.zip_with(between, F.col("new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = F.size(F.filter(F.zip_with("found", "new", lambda a, b: a != b), lambda x: x))
    text = F.when(F.col("new").isNull(), F.col("text")).otherwise(joined)
    return own.select(*[text.alias("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns if c != "n_private"], F.when(F.col("new").isNull(), F.lit(0)).otherwise(changed).cast("long").alias("n_private"))
