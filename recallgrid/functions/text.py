"""Scalar functions over fact texts, names and keys, as column expressions that stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_SIGNS = "()[]{}\"'.,:;!?"
_SPACE = r"(?U)\s+"

STOP_WORDS = sorted(
    set(
        """about above again all am an any are as at be been being below both but by can could did do does doing down each
        few for from further had has have having he her here him his how i if in into is it its just me more most my no nor
        not of off on once only or other our out over own same she should so some such than that the their them then there
        these they this those to too under up us very was we were what when which while who whom whose why will with
        would you your else a and""".split()
    )
    - {"above", "below"}
)
LEGAL_FORMS = "bv co company corp corporation gmbh inc incorporated limited llc llp lp ltd nv pa plc pllc pty sa".split()
JUNK_MARKERS = ("Direction: outboundPhone", "Direction: inboundPhoneCall", "Voice call just ended")
#: What a displayed sample may not hold: mail addresses and long digit runs.
PERSONAL = r"[-+.\w]+@[-\w]+[.]\w+|\d[\d\s().-]{7,}\d"
DURABLE = (
    r"(?i)\b(?:anniversary|birthday|equity|owns?|shares?|vesting|always|default|favou?rite|never)\b|\bprefer|\d{1,3}%"
    r"|\b\d\d?/\d\d?(?:/\d{2,4})?\b|[-+.\w]+@[-\w]+[.][.\w]+|\+?\d[\d().\s-]{7,}\d"
)


def squeeze(text: Column) -> Column:
    """Lower case with single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), _SPACE, " "))


def dedupe_key(text: Column, size: int = 160) -> Column:
    return F.substring(squeeze(F.coalesce(text, F.lit(""))), 1, size)


def split_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: F.length(w) > 0)


def tokens(text: Column) -> Column:
    """Distinct words of more than two characters as written; signs come off afterwards, so a token may be empty."""
    long = F.filter(split_words(text), lambda w: F.length(w) > 2)
    return F.array_distinct(F.transform(long, lambda w: F.lower(F.btrim(w, F.lit(EDGE_SIGNS)))))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def content_words(text: Column) -> Column:
    bare = F.transform(split_words(F.lower(text)), lambda w: F.btrim(w, F.lit(EDGE_SIGNS)))
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_join(F.filter(bare, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w)), " ")


def short_hash(text: Column, size: int = 12) -> Column:
    return F.substring(F.sha2(text, 256), 1, size)


def cluster_signature(ids: Column) -> Column:
    return short_hash(F.array_join(F.sort_array(ids).cast("array<string>"), ","))


def normalize_name(name: Column) -> Column:
    """Entity names for comparison: no case, signs, legal forms or leading article."""
    plain = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[-_.,:;|/&()'\"]+", " ")
    bare = F.regexp_replace(plain, r"\b(" + "|".join(LEGAL_FORMS) + r")\b", " ")
    one = F.trim(F.regexp_replace(bare, _SPACE, " "))
    return F.when(one.startswith("the "), F.trim(F.substring(one, 5, 1_000_000))).otherwise(one)


def domain_of(address: Column) -> Column:
    """The domain of a mail address or URL, or null."""
    text = F.lower(F.trim(address))
    host = F.when(text.contains("@"), F.substring_index(text, "@", -1)).otherwise(F.substring_index(F.regexp_replace(text, r"^[a-z]+://", ""), "/", 1))
    host = F.trim(F.substring_index(F.regexp_replace(host, r"^www\.", ""), ":", 1))
    return F.when(host.contains(".") & F.length(host).between(3, 60), host)


def phone_key(text: Column) -> Column:
    digits = F.regexp_replace(text, r"\D", "")
    return F.when(F.length(digits) >= 10, F.right(digits, F.lit(10)))


def display_name(name: Column, size: int = 40) -> Column:
    one = F.trim(F.regexp_replace(F.btrim(F.trim(name), F.lit(".,;:'\"")), _SPACE, " "))
    return F.when(F.length(one) > size, F.rtrim(F.substring(one, 1, size))).otherwise(one)


def merge_keys(norm: Column, domain: Column, email: Column, phone: Column) -> Column:
    """Identity keys, the strongest first."""
    found = F.coalesce(domain_of(domain), domain_of(email))
    mail = F.lower(F.trim(email))
    return F.array_compact(
        F.array(
            F.concat(F.lit("domain:"), found),
            F.when(mail.contains("@"), F.concat(F.lit("email:"), mail)),
            F.concat(F.lit("phone:"), phone_key(phone)),
            F.when(F.length(norm) > 0, F.concat(F.lit("norm:"), norm)),
        )
    )


def fact_id_of(vid: Column) -> Column:
    """The fact that a vector id names, or null."""
    return F.regexp_extract(vid, r"^(?:holo_fact_|gist_)([0-9]+)$", 1).try_cast("bigint")


def event_name(summary: Column, start: Column) -> Column:
    """Name of a calendar event's node: the summary, and the day unless it is unknown."""
    title = F.substring(F.coalesce(F.when(F.length(F.trim(summary)) > 0, F.trim(summary)), F.lit("(no title)")), 1, 80)
    day = F.substring(start, 1, 10)
    return F.when(F.length(day) > 0, F.concat(title, F.lit(" ("), day, F.lit(")"))).otherwise(title)


def vector_id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), key.cast("string"))


def ellipsis(text: Column, size: int = 220) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 3), F.lit("..."))).otherwise(text)


def clamp_trust(old: Column, delta: Column, ceiling: float = 0.85, floor: float = 0.35) -> Column:
    """Old trust plus delta; rises stop at the ceiling and falls at the floor, wherever the old value stood."""
    value = F.when(old == 0, F.lit(0.5)).otherwise(F.coalesce(old, F.lit(0.5)))
    return F.round(F.when(delta > 0, F.least(value + delta, F.lit(ceiling))).otherwise(F.greatest(value + delta, F.lit(floor))), 4)


def is_junk(text: Column) -> Column:
    found = F.lit(False)
    for marker in JUNK_MARKERS:
        found = found | F.coalesce(text, F.lit("")).contains(marker)
    return found


def is_protected(retrieved: Column, helpful: Column, trust: Column, default: float = 0.5) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return (zero(retrieved) > 0) | (zero(helpful) > 0) | (zero(trust) > default)


def is_durable(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(DURABLE)


def shows_personal(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(PERSONAL)


def first_json_object(text: Column) -> Column:
    """From the first opening to the last closing brace, if that parses; else null."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(F.nullif(found, F.lit(""))).isNotNull(), found)


def day_of(stamp: Column) -> Column:
    return F.substring(stamp, 1, 10)


def safe_label(text: Column) -> Column:
    """Text that may stand between double quotes."""
    return F.replace(text, F.lit('"'), F.lit("'"))


def fixed(value: Column, digits: int) -> Column:
    """A number as text for display; ties round half up, unlike some other languages."""
    return F.format_string(f"%.{digits}f", value.cast("double"))


def tidy_entities(names: Column, longest: int = 60) -> Column:
    """Cleans entity candidates in order: drops line breaks, long spans and lower-case phrases, takes off a leading verb or preposition, keeps the first of equal names."""
    lead = "and arrive arrives arriving depart departing departs for from leave leaves leaving return returning returns the visit visiting visits with".split()
    one = F.transform(F.filter(names, lambda n: n.isNotNull() & ~n.contains("\n")), lambda n: F.trim(F.regexp_replace(n, _SPACE, " ")))
    one = F.filter(one, lambda n: (F.length(n) > 0) & (F.length(n) <= longest))
    one = F.filter(one, lambda n: ~(n.rlike(r"(?U)^\p{Ll}") & (F.size(F.split(n, " ")) > 3)))

    def strip(n: Column) -> Column:
        first = F.lower(F.btrim(F.substring_index(n, " ", 1), F.lit("()\"'.,:;!?")))
        rest = F.regexp_replace(n, r"^\S+ ", "")
        led = first.isin(lead) & n.contains(" ")
        return F.when(led & rest.rlike(r"^\p{Lu}"), rest).when(~led, n)

    kept = F.array_compact(F.transform(one, strip))
    return first_of_each(kept)


def first_of_each(names: Column) -> Column:
    """Names in order without those that one before equals but for case. names is evaluated once."""
    keyed = F.transform(F.filter(names, lambda n: n.isNotNull()), lambda n: F.struct(F.lower(n).alias("key"), n.alias("name")))
    none = F.array().cast("array<struct<key:string,name:string>>")
    kept = F.aggregate(keyed, none, lambda seen, x: F.when(F.exists(seen, lambda y: y["key"] == x["key"]), seen).otherwise(F.array_append(seen, x)))
    return F.transform(kept, lambda x: x["name"])


def capitalised_words(text: Column, least: int = 4) -> Column:
    """Words of some length that begin with a capital, without the signs around them."""
    bare = F.transform(split_words(text), lambda w: F.btrim(w, F.lit(".,!?;:\"'()")))
    return F.array_distinct(F.filter(bare, lambda w: (F.length(w) >= least) & w.rlike(r"^\p{Lu}")))
