"""URL canonicalization, hashing, publisher hosts and joins as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlens.functions.text import let

# Tracking parameters, preprint hosts, code hosts, and paper paths.
TRACKING = ("fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid")
PAPER_HOSTS = ("arxiv.org", "www.arxiv.org", "export.arxiv.org")
LINK_HOSTS = ("arxiv.org", "www.arxiv.org", "github.com", "www.github.com")
PAPER_PATH = r"^/abs/(?:[0-9]{4}\.[0-9]{4,5}|[a-z-]+(?:\.[A-Z]{2})?/[0-9]{7})$"

_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _clean(url) -> Column:
    """Trim, and drop the control characters that URL readers ignore."""
    trimmed = F.regexp_replace(_col(url), r"^[\x00-\x20\s]+|[\s]+$", "")
    return F.regexp_replace(trimmed, r"[\t\r\n]", "")


def _part(url, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def _authority(url: Column) -> dict[str, Column]:
    netloc = _part(url, 2)
    address = F.regexp_replace(netloc, r"^.*@", "")
    bracketed = address.startswith("[")
    return {
        "userinfo": F.regexp_extract(netloc, r"^(.*)@", 1),
        "host": F.lower(
            F.when(bracketed, F.regexp_extract(address, r"^\[([^\]]*)\]", 1)).otherwise(
                F.regexp_extract(address, r"^([^:]*)", 1)
            )
        ),
        "port": F.when(bracketed, F.regexp_extract(address, r"\]:(.*)$", 1)).otherwise(
            F.regexp_extract(address, r":(.*)$", 1)
        ),
    }


def _ascii_host(host: Column) -> Column:
    ascii_only = host.rlike(r"^[\x00-\x7f]*$")
    labels_fit = host.rlike(r"^(?:[^.]{1,63}\.)*[^.]{0,63}$")
    encoded = F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), F.when(~ascii_only, host))
    return F.when(ascii_only & labels_fit, host).when(~ascii_only, encoded)


def _form_decode(text: Column) -> Column:
    escaped = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(escaped), text)


def _form_encode(text: Column) -> Column:
    encoded = F.url_encode(text)
    return F.replace(F.replace(encoded, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _query(query: Column) -> Column:
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(
            _form_decode(F.substring_index(p, "=", 1)).alias("key"),
            F.when(
                F.instr(p, "=") > 0, _form_decode(F.regexp_replace(p, r"(?s)^[^=]*=", ""))
            ).otherwise("").alias("value"),
        ),
    )
    kept = F.filter(
        pairs,
        lambda p: ~F.lower(p["key"]).startswith("utm_") & ~F.lower(p["key"]).isin(*TRACKING),
    )
    return F.array_join(
        F.transform(
            F.array_sort(kept),
            lambda p: F.concat(_form_encode(p["key"]), F.lit("="), _form_encode(p["value"])),
        ),
        "&",
    )


def canonical_url(url) -> Column:
    """One spelling per page; null where the URL is not an acceptable absolute HTTP(S) URL."""
    return let(_clean(url), lambda cleaned: let(_pieces(cleaned), _spell))


def _pieces(url: Column) -> Column:
    parts = _authority(url)
    return F.struct(
        F.lower(_part(url, 1)).alias("scheme"),
        parts["userinfo"].alias("userinfo"),
        let(parts["host"], _ascii_host).alias("host"),
        parts["port"].alias("port"),
        _part(url, 3).alias("path"),
        _query(_part(url, 4)).alias("query"),
    )


def _spell(p: Column) -> Column:
    scheme, host, number = p["scheme"], p["host"], p["port"].try_cast("int")
    default_port = (
        (p["port"] == "")
        | (number == 0)
        | ((scheme == "http") & (number == 80))
        | ((scheme == "https") & (number == 443))
    )
    valid = (
        scheme.isin("http", "https")
        & p["userinfo"].isin("", ":")
        & host.isNotNull()
        & (host != "")
        & ((p["port"] == "") | (p["port"].rlike(r"^[0-9]{1,9}$") & (number <= 65535)))
    )
    shown = F.concat(
        F.when(F.contains(host, F.lit(":")), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host),
        F.when(default_port, "").otherwise(F.concat(F.lit(":"), number.cast("string"))),
    )
    path = F.when(p["path"] == "", "/").otherwise(p["path"])
    paper_path = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(path, "^/pdf/", "/abs/"), r"\.pdf$", ""), r"v\d+$", ""
    )
    paper = shown.isin(*PAPER_HOSTS)
    return F.when(
        valid,
        F.concat(
            F.when(paper, "https").otherwise(scheme),
            F.lit("://"),
            F.when(paper, "arxiv.org").otherwise(shown),
            F.when(paper, paper_path).otherwise(path),
            F.when(p["query"] == "", "").otherwise(F.concat(F.lit("?"), p["query"])),
        ),
    )


def hash_of(canonical) -> Column:
    """SHA-256 of an already canonical URL."""
    return F.sha2(_col(canonical), 256)


def url_hash(url) -> Column:
    return hash_of(canonical_url(url))


def hostname(url) -> Column:
    """Lower-case host, or null."""
    host = _authority(_clean(url))["host"]
    return F.when(host != "", host)


def publisher(url, source_id) -> Column:
    """Host without a leading ``www.``; the source stands in where there is none."""
    host = F.regexp_replace(hostname(url), r"^www\.", "")
    return F.coalesce(host, F.concat(F.lit("source:"), _col(source_id).cast("string")))


def is_paper_url(url) -> Column:
    """Whether a canonical URL names a paper, in the new or the old identifier style."""
    url = _col(url)
    return (hostname(url) == "arxiv.org") & _part(url, 3).rlike(PAPER_PATH)


def is_evidence_link(canonical) -> Column:
    """Paper or code host with a non-empty path."""
    canonical = _col(canonical)
    return hostname(canonical).isin(*LINK_HOSTS) & (F.btrim(_part(canonical, 3), F.lit("/")) != "")


def safe_url(url) -> Column:
    """Link that may be shown: HTTP(S), no credentials, normalized origin; else null."""
    url = _clean(url)
    scheme = F.lower(_part(url, 1))
    parts = _authority(url)
    host = _ascii_host(parts["host"])
    port = parts["port"]
    shown = F.when(
        (port == "")
        | ((scheme == "http") & (port == "80"))
        | ((scheme == "https") & (port == "443")),
        "",
    ).otherwise(F.concat(F.lit(":"), port))
    tail = F.regexp_extract(url, r"(?s)^[^:]*://[^/?#]*(.*)$", 1)
    ok = (
        scheme.isin("http", "https")
        & (parts["host"] != "")
        & host.isNotNull()
        & parts["userinfo"].isin("", ":")
        & port.rlike(r"^[0-9]{0,5}$")
        & ~parts["host"].rlike(r"[\s<>^|%]")
    )
    return F.when(
        ok,
        F.concat(
            scheme,
            F.lit("://"),
            host,
            shown,
            F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail)),
        ),
    )


def display_publisher(url) -> Column:
    """Host to show next to a link."""
    safe = safe_url(url)
    return F.when(safe.isNull(), "Source").otherwise(F.regexp_replace(hostname(safe), r"^www\.", ""))


def _tidy(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    walked = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((s == ".") | (s == ""), acc)
        .otherwise(F.array_append(acc, s)),
    )
    body = F.concat(F.lit("/"), F.array_join(walked, "/"))
    directory = last.isin("", ".", "..") & (F.size(walked) > 0)
    return F.concat(body, F.when(directory, "/").otherwise(""))


def url_join(base, link) -> Column:
    """Resolve a link found in a document against the document's own URL."""
    base, link = _clean(base), _clean(link)
    absolute = link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    origin = F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    base_path = F.when(_part(base, 3) == "", "/").otherwise(_part(base, 3))
    path = F.regexp_extract(link, r"(?s)^([^?#]*)", 1)
    tail = F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    base_query = F.when(_part(base, 4) == "", "").otherwise(F.concat(F.lit("?"), _part(base, 4)))
    folder = F.regexp_replace(base_path, r"[^/]*$", "")
    return (
        F.when(link == "", base)
        .when(absolute, link)
        .when(link.startswith("//"), F.concat(_part(base, 1), F.lit(":"), link))
        .when(
            path == "",
            F.concat(
                origin,
                _part(base, 3),
                F.when(tail.startswith("?"), tail).otherwise(F.concat(base_query, tail)),
            ),
        )
        .when(path.startswith("/"), F.concat(origin, _tidy(path), tail))
        .otherwise(F.concat(origin, _tidy(F.concat(folder, path)), tail))
    )
