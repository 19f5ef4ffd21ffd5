"""Text, URL and label functions as column expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Bytes of text that Python looks at together.
AT_ONCE = 1 << 20
#: Query parameters that only track, without case; others that do start with the prefix and have more.
TRACKING = ("fbclid", "gclid", "yclid", "mc_cid", "mc_eid", "ref", "cmpid", "ncid", "ico")
TRACKING_PREFIX = "utm_"
#: Words of titles that tell nothing, in English and Turkish.
TITLE_STOPS = (
    "the a an and or of to in on for with at by from as is are was were be been after over amid into new says say said report reports reported reportedly "
    "update live video watch photos breaking ve ile icin de da bir bu o ama cok gibi"
).split()


@lru_cache(1)
def _marks() -> tuple[str, str]:
    """Letters that are one base letter and marks, and those base letters."""
    pairs = [(chr(c), base[0]) for c in range(0xC0, min(sys.maxunicode, 0x2000)) if len(base := "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not 0x300 <= ord(x) <= 0x36F)) == 1 and base != chr(c)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without accents; null stays null."""
    return F.regexp_replace(F.translate(F.lower(text), *_marks()), "[\\u0300-\\u036f]", "")


def plain_words(text: Column) -> Column:
    """Folded text as words of a-z and 0-9, one space between them."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))


#: Turkish names with the endings that are taken off, and the name that two words stand for.
ENDINGS = (("gazz[ea]", "gazze", "ye|de|den|nin"), ("lubnan", "lubnan", "a|da|dan|in|nin"), ("israil", "israil", "den|de|e|li|liler|in|nin"), ("bati seria", "bati seria", "da|dan|ya|nin"), ("dso", "dso", "den|de|ye|nun"), ("bmmyk", "bmm yk", ""))


def filter_words(text: Column) -> Column:
    """``plain_words`` with dotless i as i and some Turkish names without their endings, as filters and lexicons take them; null stays null."""
    words = plain_words(F.replace(F.lower(text), F.lit("ı"), F.lit("i")))
    bare = words
    for name, plain, endings in ENDINGS:
        bare = F.regexp_replace(bare, rf"\b{name}(?:{endings})?\b", plain)
    return F.when(words.rlike("|".join(name for name, _, _ in ENDINGS)), bare).otherwise(words)


def pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """Parts of a batch of texts, of about AT_ONCE bytes or one text, so that Python's strings of a whole batch never stand in memory together."""
    if not len(texts):
        yield texts
        return
    part = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        yield texts.slice(a, b - a)


@F.arrow_udf(StringType())
def compatible(text: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Unicode's compatibility decomposition, which Spark has no function for."""
    for batch in text:
        for part in pieces(batch):
            yield pa.array([x if x is None or x.isascii() else unicodedata.normalize("NFKD", x) for x in part.to_pylist()], pa.string())


def title_key(text: Column) -> Column:
    """Lower case, decomposed, without accents; runs of anything but letters and digits of any script are one space. Null is empty."""
    plain = F.regexp_replace(compatible(F.lower(F.coalesce(text, F.lit("")))), "[\u0300-\u036f]", "")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def tokens(text: Column) -> Column:
    """Distinct title tokens of three characters or more that are no stop words, a plural s of five or more dropped."""
    plain = plain_words(F.replace(F.lower(text), F.lit("ı"), F.lit("i")))
    long = F.filter(F.split(plain, " "), lambda w: (F.length(w) >= 3) & ~w.isin(*TITLE_STOPS))
    return F.array_distinct(F.transform(long, lambda w: F.when((F.length(w) >= 5) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)))


def first_sentence(text: Column) -> Column:
    return F.split(text, "[.!?]\\s").getItem(0)


def canonical_url(url: Column) -> Column:
    """http(s) only: scheme and host in lower case, no default port, fragment, tracking parameters or slash at the end of a path; else null.

    Parameters are decoded and encoded again as forms do. Hosts stay as written but for case; dots in paths aren't resolved.
    """
    pattern = r"^(?i)(https?)://((?:[^/?#@\s]*@)?)((?:\[[0-9a-f:.]+\]|[^/?#@:\[\]\s<>^|%]+))(?::(\d*))?([/\\][^?#]*)?(?:\?([^#]*))?(?:#.*)?$"
    part = lambda i: F.regexp_extract(F.trim(url), pattern, i)
    scheme, port = F.lower(part(1)), part(4)

    def decoded(x: Column) -> Column:
        return F.coalesce(F.try_url_decode(x), x)

    def name(p: Column) -> Column:
        return decoded(F.split(p, "=", 2).getItem(0))

    def tracks(p: Column) -> Column:
        key = F.lower(name(p))
        return key.isin(*TRACKING) | key.rlike(f"^{TRACKING_PREFIX}[a-z0-9_]+$")

    kept = F.filter(F.split(part(6), "&"), lambda p: (p != "") & ~tracks(p))
    query = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(name(p)), F.lit("="), F.url_encode(decoded(F.coalesce(F.get(F.split(p, "=", 2), F.lit(1)), F.lit("")))))), "&")
    path = F.regexp_replace(part(5), "/+$", "")
    shown = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(F.concat(F.lit(":"), port))
    whole = F.concat(scheme, F.lit("://"), part(2), F.lower(part(3)), shown, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(scheme != "", whole)


def fingerprint(source: Column, title: Column, published: Column) -> Column:
    """SHA-256 of source, the title's key and publication time; missing times are empty."""
    return F.sha2(F.concat_ws("\n", source, title_key(title), F.coalesce(published.cast("string"), F.lit(""))), 256)


def event_key(source: Column, upstream: Column, print_: Column) -> Column:
    return F.concat_ws("::", source, F.coalesce(upstream.cast("string"), print_))


@lru_cache(1)
def _address_patterns() -> tuple[str, str]:
    """Patterns of whole IPv4 and IPv6 literals."""
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    v4, group = rf"(?:{octet}\.){{3}}{octet}", "[0-9a-f]{1,4}"
    forms = [rf"(?:{group}:){{7}}{group}", rf"(?:{group}:){{6}}{v4}"]
    for left in range(8):  # groups before the gap
        head = "" if not left else rf"{group}(?::{group}){{{left - 1}}}"
        right = 7 - left  # most groups after it
        forms.append(rf"{head}::(?:{group}(?::{group}){{0,{right - 1}}})?" if right else rf"{head}::")
        if right >= 2:
            forms.append(rf"{head}::(?:{group}:){{0,{right - 2}}}{v4}")
    return v4, "(?:" + "|".join(forms) + r")(?:%[0-9a-z\-.:]+)?"


def private_address(ip: Column) -> Column:
    """Whether an address is private, loopback, link-local, shared, unique local or reserved. Null and whatever is no IP literal: true."""
    v4, v6 = _address_patterns()
    low = F.lower(ip)
    mapped = F.regexp_replace(low, "^::ffff:", "")
    four = F.regexp_extract(mapped, rf"^({v4})$", 1)
    a, b = (F.split(four, "\\.").getItem(i).try_cast("int") for i in (0, 1))
    inside = a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 100) & b.between(64, 127))
    six = low.rlike(f"^(?:{v6})$")
    return F.coalesce(F.when(four != "", inside).when(six, low.rlike("^(::1?$|f[cd]|fe80:|::ffff:)")), F.lit(True))


def csv_cell(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(value.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def confidence(score: Column, official: Column, strong_geo: Column) -> Column:
    """Tier of a score with lifts for official sources and strong locations."""
    lifted = F.coalesce(score, F.lit(0)) + F.when(official, 25).otherwise(0) + F.when(strong_geo, 10).otherwise(0)
    return F.when(lifted >= 70, "high").when(lifted >= 40, "medium").otherwise("low")


def time_ago(seconds: Column) -> Column:
    """Age in the largest whole unit: 'just now' below a minute and for future times, empty for missing ones."""
    minutes = F.floor(F.greatest(seconds, F.lit(0)) / 60)
    return (
        F.when(seconds.isNull(), "").when(minutes < 1, "just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d ago")))
    )
