"""Page copy and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import once

# Verbs and terms of a call to action; words that say nothing of a goal.
CTA_VERBS = ("get", "start", "try", "buy", "sign", "subscribe", "join", "download", "book", "request", "contact", "learn", "discover", "see", "watch", "explore", "schedule", "claim", "unlock")
URGENCY_TERMS = ("now", "today", "free", "limited", "exclusive", "instantly", "guarantee", "risk-free", "no credit card", "cancel anytime")
STOP_WORDS = ("a", "an", "the", "and", "or", "for", "to", "of", "in", "on", "with")


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+", -1), lambda w: w != "")


def sentence_length(text: Column) -> Column:
    """Mean words a sentence; blank sentences do not count; none is 0."""
    said = F.regexp_count(text, F.lit("[^ .!?][^.!?]*"))
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\s.!?]+")) / F.nullif(said, F.lit(0)), F.lit(0.0))


def clarity(word_count: Column, sentence: Column) -> Column:
    base = F.when(sentence <= 15, F.lit(100.0)).when(sentence >= 40, F.lit(40.0)).otherwise(100.0 - (sentence - 15) / 25.0 * 60.0)
    return F.when(word_count < 10, base * 0.6).when(word_count > 500, base * 0.45).otherwise(base)


def urgency(text: Column) -> Column:
    """16 points for each verb or term that the text holds anywhere, 100 at most."""
    hits = lambda low: sum((low.contains(term).cast("int") for term in CTA_VERBS + URGENCY_TERMS), F.lit(0))
    return F.least(F.lit(100.0), once(F.lower(F.coalesce(text, F.lit(""))), hits) * 16.0)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def goal_fit(text: Column, goal: Column) -> Column:
    wanted = F.array_except(tokens(goal), F.array(*map(F.lit, STOP_WORDS)))
    share = F.size(F.array_intersect(wanted, tokens(text))) / F.size(wanted)
    return F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(F.least(F.lit(100.0), share * 200.0))


def copy_score(clear: Column, urgent: Column, fit: Column | None = None) -> Column:
    return 0.6 * clear + 0.4 * urgent if fit is None else 0.5 * clear + 0.3 * urgent + 0.2 * fit


def copy_flags(word_count: Column, urgent: Column) -> Column:
    return F.array_compact(F.array(F.when(word_count < 10, F.lit("sparse_content")), F.when(word_count > 400, F.lit("wall_of_text")), F.when(urgent > 70, F.lit("strong_cta"))))


def url_path(url: Column) -> Column:
    """Path, with the query where there is one; '/' for none."""
    path = F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    query = F.try_parse_url(url, F.lit("QUERY"))
    return F.when(query.isNotNull() & (query != ""), F.concat(path, F.lit("?"), query)).otherwise(path)


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit("unknown"))


def same_origin(href: Column, base: Column) -> Column:
    """Relative links, the same host, and its subdomains. An absolute link without a host, or a base without one, is another origin."""
    name = lambda url: F.nullif(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))
    relative = ~href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:") & ~href.startswith("//")
    return relative | F.coalesce((name(href) == name(base)) | F.endswith(name(href), F.concat(F.lit("."), name(base))), F.lit(False))


#: Address ranges that no fetch may reach, as first and last address: this network, private, shared metadata, loopback, link-local,
#: protocol assignments, documentation, benchmarks, multicast and reserved. Fixed values.
_NO_FETCH = (
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"), ("100.100.100.200", "100.100.100.200"), ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"), ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"),
    ("192.168.0.0", "192.168.255.255"), ("198.18.0.0", "198.19.255.255"), ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"),
    ("224.0.0.0", "255.255.255.255"),
)


def url_allowed(url: Column) -> Column:
    """Whether a crawler may fetch an address: http or https, no credentials, a host, and no address in a forbidden range.

    Names are not resolved here, but for localhost and what ends with it; a fetcher checks the addresses that they resolve to in
    the same way. Refused are hosts of digits or hexadecimal numbers alone, which resolvers read as addresses; hosts with any
    character but letters, digits, dots and hyphens of ASCII, as resolvers turn others into these; and addresses with a backslash,
    which some read as a slash. Of IPv6 only well-formed global addresses pass (2000::/3), without those that carry an IPv4
    address (6to4, Teredo), protocol assignments and documentation.
    """
    place = F.regexp_extract(url, r"^(?i:https?)://([^/?#\\]*)", 1)
    name = F.lower(F.regexp_replace(F.regexp_replace(place, r":[0-9]*$", ""), r"\.$", ""))
    octets = F.split(name, r"\.")
    value = F.aggregate(F.transform(octets, lambda o: o.try_cast("bigint")), F.lit(0).cast("long"), lambda a, o: a * 256 + o)
    dotted = name.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    number = lambda ip: sum(int(o) << 8 * (3 - i) for i, o in enumerate(ip.split(".")))
    forbidden = F.lit(False)
    for low, high in _NO_FETCH:
        forbidden = forbidden | value.between(number(low), number(high))
    valid = F.forall(octets, lambda o: o.try_cast("int") <= 255)
    six = F.lower(F.regexp_extract(place, r"^\[([0-9A-Fa-f:]+)\](?::[0-9]*)?$", 1))
    group = "[0-9a-f]{1,4}"
    shortened = six.rlike(f"^{group}(?::{group})*::(?:{group}(?::{group})*)?$") & (F.size(F.filter(F.split(six, ":"), lambda g: g != "")) <= 7)
    whole = six.rlike(f"^{group}(?::{group}){{7}}$") | shortened
    carries = six.rlike(r"^(?:2002:|2001:(?:0{0,3}[0-9a-f]|0{0,2}[0-9a-f]{2}|0?1[0-9a-f]{2}|0?db8)?:|3fff:0?[0-9a-f]{0,3}:)")
    public = whole & six.rlike("^[23][0-9a-f]{3}:") & ~carries
    odd = name.rlike(r"^(?:0x[0-9a-f]*|[0-9.]+)(?:\.(?:0x[0-9a-f]+|[0-9]+))*$") & ~dotted
    named = ~name.rlike(r"^(?:.*\.)?localhost$") & ~odd & F.when(dotted, valid & ~forbidden).otherwise(True)
    host_ok = F.when(place.startswith("["), public).otherwise(name.rlike("^[a-z0-9.-]+$") & named)
    return F.coalesce((place != "") & ~F.contains(url, F.lit("\\")) & ~F.contains(place, F.lit("@")) & host_ok, F.lit(False))
