"""Identity: content-derived ids, URL keys, domains, DOIs and source kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters and ports that do not name a page; file
# endings that hold no text; hosts that tell a source's kind.
CLICK_IDS = "fbclid gclid dclid msclkid mc_cid mc_eid igshid _ga".split()
NOT_TEXT = "jpg jpeg png gif webp svg ico bmp mp3 mp4 m4a wav avi mov webm mkv zip gz tar rar 7z exe dmg css js woff".split()
VIDEO = "youtube.com youtu.be vimeo.com".split()
COURT = "courtlistener.com supremecourt.gov uscourts.gov".split()
PAPER = "arxiv.org pubmed.ncbi.nlm.nih.gov pmc.ncbi.nlm.nih.gov".split()


def hash63(value: Column) -> Column:
    """First 8 bytes of SHA-256 without the sign bit, as a bigint; null for null."""
    h = F.sha2(value, 256)
    high = F.conv(F.substring(h, 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF))
    low = F.conv(F.substring(h, 9, 8), 16, 10).cast("long")
    return high * F.lit(1 << 32) + low


def joined_id(kind: str, *parts: Column) -> Column:
    """``hash63`` of NUL-joined parts under a kind: document, passage, claim."""
    return hash63(F.concat_ws("\0", F.lit(kind), *[p.cast("string") for p in parts]))


def domain_of(key: Column) -> Column:
    """The part of a URL key before its first slash or question mark."""
    return F.regexp_extract(key, r"^[^/?]*", 0)


def _percent(encoded: Column, plain: str) -> Column:
    """Form-encoded text as percent-encoded text that leaves the characters of ``plain`` alone."""
    out = F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    for c in plain:
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def url_key(url: Column) -> Column:
    """The one key of a page: its http(s) URL without what does not name it; null for any other text.

    Without scheme, user, ``www.``, default port, fragment, trailing slashes,
    ``utm_`` and click parameters; host in lower case, parameters sorted, no
    needless escapes (a path with an escaped separator stays as it is).  Built
    from built-in expressions; bytes that are no UTF-8 count as U+FFFD.
    """
    u = F.regexp_replace(F.regexp_replace(url, r"^\s+|\s+$", ""), r"#.*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(u, r"^(?i:https?)://([^/?]*)", 1), r"^.*@", ""))
    valid = u.rlike(r"^(?i:https?)://") & ~u.rlike(r"[\x00-\x1f\x7f]") & host.rlike(r"^(?:[^:\s\[\]]+|\[[^\]\s]+\])(?::\d*)?$")
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r":(?:80|443)?$", ""), r"^www\.", ""), r"^\[(.*)\]", "$1")
    raw = F.regexp_replace(F.regexp_extract(u, r"^[^:]*://[^/?]*([^?]*)", 1), r"/+$", "")
    decoded = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    path = F.when(raw.rlike("(?i)%(?:2f|3f|23)"), raw).otherwise(_percent(F.replace(F.url_encode(decoded), F.lit("+"), F.lit("%20")), "/$&+,:;=@"))
    pairs = F.filter(F.split(F.regexp_extract(u, r"^[^?]*\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.contains(";"))
    pairs = F.transform(pairs, lambda p: F.struct(F.try_url_decode(F.regexp_extract(p, "^[^=]*", 0)).alias("k"), F.try_url_decode(F.regexp_replace(p, "^[^=]*=?", "")).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: p["k"].isNotNull() & p["v"].isNotNull() & ~F.lower(p["k"]).rlike(rf"^(?:utm_.*|{'|'.join(CLICK_IDS)})$")))
    tail = F.array_join(F.transform(kept, lambda p: F.concat(_percent(F.url_encode(p["k"]), ""), F.lit("="), _percent(F.url_encode(p["v"]), ""))), "&")
    return F.when(valid, F.concat(host, path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(F.lit(""))))


def doi_of(text: Column) -> Column:
    """The DOI in a URL, path, query value or prefixed string, in lower case."""
    found = F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)(10\.\d{4,9}/[^\s?#&\"<>]+)", 1))
    return F.nullif(F.regexp_replace(found, r"[.,;)\]]+$", ""), F.lit(""))


def source_kind(domain: Column, doi: Column) -> Column:
    """paper, video, court or web."""
    at = lambda hosts: F.greatest(F.lit(False), *[(domain == h) | domain.endswith("." + h) for h in hosts])
    return (
        F.when(doi.isNotNull(), "paper").when(at(VIDEO), "video").when(at(COURT), "court").when(at(PAPER), "paper").otherwise("web")
    )


def on_domain(domain: Column, wanted: str) -> Column:
    """The wanted domain or one of its subdomains."""
    d = wanted.strip().lower().removeprefix("www.")
    return (domain == d) | domain.endswith("." + d)


def fetchable(url: Column) -> Column:
    """An http(s) URL with a host whose path does not end like media or an asset."""
    ending = F.lower(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"://[^/]+/.*\.([A-Za-z0-9]+)$", 1))
    return url.rlike(r"^(?i:https?)://[^/?#\s]+") & ~ending.isin(NOT_TEXT)


def slug(text: Column) -> Column:
    """Lower-case letters and digits with single dashes; ``unnamed`` if none."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", "unnamed").otherwise(s)


def masked_dsn(dsn: Column) -> Column:
    """A connection string with its password masked."""
    return F.regexp_replace(dsn, r"(://[^:/@\s]+):[^@\s]*@", "$1:***@")
