"""URL expressions over string columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwright import constants as K
from shelfwright.functions import js

_ABSOLUTE = r"(?s)^[\s\x00]*([\w+.\-]{2,}:)?//([^/@]+@)?([^#/?]*)([^#?]*)(\?[^#]*)?(#.*)?$"
_RELATIVE = r"(?s)^([^#?]*)(\?[^#]*)?(#.*)?$"
_PROTOCOL = r"^[\s\w\x00+.\-]{2,}:"
# No slashes to collapse; and with a protocol, no query and no slashes: normal as it is.
_SINGLE = r"(?s)^[^/]*://(?!.*//)"
_NORMAL = r"(?s)^[\w+.\-]{2,}://(?!.*//)[^?]*\z"
_PROTOCOL_RELATIVE = r"^([/\\]\s*){2,}[^/\\]"


def has_protocol(url: Column) -> Column:
    return url.rlike(_PROTOCOL)


def _is_absolute(url: Column) -> Column:
    return url.rlike(_PROTOCOL) | url.rlike(_PROTOCOL_RELATIVE)


def _slashes(url: Column) -> Column:
    return F.translate(url, "\\", "/")


def _part(url: Column, absolute_group: int, relative_group: int) -> Column:
    return F.when(
        _is_absolute(url), F.regexp_extract(_slashes(url), _ABSOLUTE, absolute_group)
    ).otherwise(
        F.regexp_extract(url, _RELATIVE, relative_group) if relative_group else F.lit(None)
    )


def url_protocol(url: Column) -> Column:
    return F.lower(_part(url, 1, 0))


def url_host(url: Column) -> Column:
    """Host with port; null for a relative URL."""
    return _part(url, 3, 0)


def url_path(url: Column) -> Column:
    return _part(url, 4, 1)


def url_search(url: Column) -> Column:
    return _part(url, 5, 2)


def url_hash(url: Column) -> Column:
    return _part(url, 6, 3)


def url_origin(url: Column) -> Column:
    return F.concat(url_protocol(url), F.lit("//"), url_host(url))


def url_components(url: Column) -> Column:
    return F.struct(
        url_protocol(url).alias("protocol"),
        url_host(url).alias("host"),
        url_path(url).alias("pathname"),
        url_search(url).alias("search"),
        url_hash(url).alias("hash"),
        url_origin(url).alias("origin"),
    )


def url_domain(url: Column) -> Column:
    return F.coalesce(url_host(url), F.lit(""))


def is_valid_url(url: Column) -> Column:
    return (F.coalesce(url_protocol(url), F.lit("")) != "") & (url_domain(url) != "")


def _before_search(url: Column) -> Column:
    """Everything up to the path, protocol in lower case."""
    auth = F.regexp_extract(_slashes(url), _ABSOLUTE, 2)
    absolute = F.concat(
        url_protocol(url), F.lit("//"), auth, url_host(url), url_path(url)
    )
    return F.when(_is_absolute(url), absolute).otherwise(url_path(url))


def _decode(text: Column) -> Column:
    """Form decoding that leaves a stray percent sign as it is."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def query_entries(search: Column) -> Column:
    """Decoded key/value structs of a query string, in order."""
    pieces = F.filter(
        F.split(F.regexp_replace(search, r"^\?", ""), "&"), lambda p: p != ""
    )
    return F.transform(
        pieces,
        lambda p: F.struct(
            _decode(F.regexp_extract(p, "(?s)^([^=]*)", 1)).alias("k"),
            _decode(F.regexp_extract(p, "(?s)=(.*)$", 1)).alias("v"),
        ),
    )


def query_string(entries: Column) -> Column:
    """``?k=v&k=v`` in form encoding, or '' without entries."""
    pairs = F.transform(
        entries,
        lambda e: F.concat(F.url_encode(e["k"]), F.lit("="), F.url_encode(e["v"])),
    )
    # An entry is never empty text, so only an empty list leaves the bare mark.
    return F.regexp_replace(F.concat(F.lit("?"), F.array_join(pairs, "&")), r"^\?$", "")


def _without_tracking(search: Column) -> Column:
    return query_string(
        F.filter(query_entries(search), lambda e: ~e["k"].isin(K.TRACKING_PARAMS))
    )


def strip_tracking(url: Column) -> Column:
    """Drop tracking parameters; a URL without a query comes back unchanged."""
    return F.when(url_search(url) == "", url).otherwise(
        F.concat(_before_search(url), _without_tracking(url_search(url)), url_hash(url))
    )


def single_slashes(url: Column) -> Column:
    """Collapse repeated slashes except the ones after a protocol."""
    collapsed = F.array_join(
        F.transform(
            F.split(url, "://"), lambda part: F.regexp_replace(part, "/{2,}", "/")
        ),
        "://",
    )
    return F.when(url.rlike(_SINGLE), url).otherwise(collapsed)


def canonical_url(url: Column) -> Column:
    """No hash; parameters sorted by key, first value of a repeated key."""
    entries = query_entries(url_search(url))
    keys = F.transform(entries, lambda e: e["k"])
    firsts = F.filter(entries, lambda e, i: F.array_position(keys, e["k"]) == i + 1)
    return F.concat(
        _before_search(url),
        F.when(url_search(url) == "", F.lit("")).otherwise(
            query_string(F.array_sort(firsts))
        ),
    )


def remove_params(url: Column) -> Column:
    return F.concat(_before_search(url), url_hash(url))


def clean_url(url: Column) -> Column:
    return _before_search(url)


def join_url(base: Column, path: Column) -> Column:
    """Base and path with exactly one slash between them; an empty path adds nothing."""
    tail = F.regexp_replace(path, r"^\.?/", "")
    joined = F.concat(F.regexp_replace(base, "/$", ""), F.lit("/"), tail)
    return (
        F.when(path.isNull(), F.lit(None).cast("string"))
        .when(path.isin("", "/"), base)
        .when(F.coalesce(base, F.lit("")) == "", path)
        .otherwise(joined)
    )


def resolve_url(base: Column, url: Column) -> Column:
    return F.when(has_protocol(url), url).otherwise(join_url(base, url))


def normalize_url(url: Column, base: Column) -> Column:
    """Absolute: without tracking parameters and repeated slashes. Relative: joined to the base."""
    # The general strip_tracking also covers relative URLs; here a few parts are enough.
    text = _slashes(url)
    head = r"(?s)^[\s\x00]*([\w+.\-]{2,}:)?(//(?:[^/@]+@)?[^#?]*)"
    scheme = F.regexp_extract(text, head, 1)
    stripped = F.concat(
        F.when(url.rlike("^[a-z]+:"), scheme).otherwise(F.lower(scheme)),
        F.regexp_extract(text, head, 2),
        _without_tracking(F.regexp_extract(text, _ABSOLUTE, 5)),
        F.regexp_extract(text, _ABSOLUTE, 6),
    )
    clean = F.when(url.rlike(r"^[^#]*\?"), stripped).otherwise(url)
    return (
        F.when(url.rlike(_NORMAL), url)
        .when(has_protocol(url), js.let(clean, single_slashes))
        .otherwise(join_url(base, url))
    )


def with_query(url: Column, params: Mapping[str, Column | str]) -> Column:
    """Set query parameters: existing keys keep their place and take the new value."""
    values = {k: v if isinstance(v, Column) else F.lit(v) for k, v in params.items()}
    entries = query_entries(url_search(url))

    def updated(e: Column) -> Column:
        value = e["v"]
        for k, v in values.items():
            value = F.when(e["k"] == k, v).otherwise(value)
        return F.struct(e["k"].alias("k"), value.alias("v"))

    present = F.transform(entries, lambda e: e["k"])
    added = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in values.items()])
    fresh = F.filter(added, lambda e: ~F.array_contains(present, e["k"]))
    merged = F.concat(F.transform(entries, updated), fresh)
    return F.concat(_before_search(url), query_string(merged), url_hash(url))


def search_url(base: Column, query: Column, filters: Mapping[str, Column | str] = {}) -> Column:
    return with_query(join_url(base, F.lit("/search")), {"q": query, **filters})


def site_from_url(url: Column) -> Column:
    """Site of a known host, else 'unknown'. The host table is a fixed short list."""
    host = url_host(url)
    site = F.lit("unknown")
    for known, name in K.HOST_SITES.items():
        site = F.when(host == known, F.lit(name)).otherwise(site)
    return site


def _any_marker(text: Column, markers: list[str]) -> Column:
    return text.rlike("|".join(markers))


def is_product_url(url: Column) -> Column:
    return _any_marker(url_path(url), K.PRODUCT_MARKERS)


def is_collection_url(url: Column) -> Column:
    return _any_marker(url_path(url), K.COLLECTION_MARKERS)


def category_from_url(url: Column) -> Column:
    found = [
        F.nullif(F.regexp_extract(url_path(url), f"/{word}/([^/?]+)", 1), F.lit(""))
        for word in K.CATEGORY_PATHS
    ]
    return F.coalesce(*found, F.lit("unknown"))


def is_external_url(url: Column, base: Column) -> Column:
    return ~url_host(url).eqNullSafe(url_host(base))


def _ascii(text: Column) -> Column:
    """Non-ASCII characters as percent codes."""
    coded = F.array_join(
        F.transform(
            F.split(text, ""),
            lambda ch: F.when(ch.rlike(r"[^\x00-\x7F]"), F.url_encode(ch)).otherwise(ch),
        ),
        "",
    )
    return F.when(text.rlike(r"[^\x00-\x7F]"), coded).otherwise(text)


def page_address(page_url: Column) -> Column:
    """What links of a page are resolved against, as a struct: the parts of the page address."""
    path = url_path(page_url)
    folder = F.regexp_extract(path, "(?s)^(.*/)", 1)
    general = F.struct(
        url_protocol(page_url).alias("protocol"), url_origin(page_url).alias("origin"), path.alias("path"),
        F.when(folder == "", F.lit("/")).otherwise(folder).alias("folder"),
    )
    # The same of an address in normal form, by fewer patterns.
    plain = F.struct(
        F.regexp_extract(page_url, "^([a-z]+:)", 1).alias("protocol"),
        F.regexp_extract(page_url, "^([a-z]+://[^/]+)", 1).alias("origin"),
        F.regexp_extract(page_url, "^[a-z]+://[^/]+([^?#]*)", 1).alias("path"),
        F.regexp_extract(page_url, "^[a-z]+://[^/]+([^?#]*/)", 1).alias("folder"),
    )
    return F.when(page_url.rlike(_PLAIN_WEB), plain).otherwise(general)


def page_href(page_url: Column, href: Column, address: Column | None = None) -> Column:
    """What a link on a page points to: ``href`` resolved against the page address.

    ``address`` is ``page_address`` of the page where many links are resolved.
    """
    parts = page_address(page_url) if address is None else address

    def resolved(h: Column) -> Column:
        return (
            F.when(has_protocol(h), h)
            .when(h.startswith("//"), F.concat(parts["protocol"], h))
            .when(h.startswith("/"), F.concat(parts["origin"], h))
            .when(h.startswith("?"), F.concat(parts["origin"], parts["path"], h))
            .when(
                (h == "") | h.startswith("#"),
                F.concat(F.regexp_replace(page_url, "(?s)#.*$", ""), h),
            )
            .otherwise(F.concat(parts["origin"], parts["folder"], h))
        )

    return js.let(
        js.let(href, resolved), lambda r: F.when(r.rlike(_PLAIN_WEB), r).otherwise(F.coalesce(web_href(r), r))
    )


# A web URL in normal form: host in lower case and without a port, no back slash, blank, non-ASCII text or dot segment.
_PLAIN_WEB = r"^https?://[a-z0-9-]+(?:\.[a-z0-9-]+)*(?![^?#]*/\.\.?(?:[/?#]|\z))/[!-\[\]-~]*\z"
_WEB = r"(?is)^(https?):[/\\]*([^/\\?#]+)([^?#]*)(\?[^#]*)?(#.*)?$"
_OTHER = r"(?is)^(?!https?:)[a-z][a-z0-9+.\-]*:"


def _fold_dots(path: Column) -> Column:
    """A path, without its first slash, after its ``.`` and ``..`` segments are worked off."""

    def walk(acc: Column, seg: Column) -> Column:
        return (
            F.when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(seg == ".", acc)
            .otherwise(F.concat(acc, F.array(seg)))
        )

    def fold(segments: Column) -> Column:
        folded = F.aggregate(segments, F.array().cast("array<string>"), walk)
        ends_in_dots = F.element_at(segments, -1).isin(".", "..")
        tail = F.when(ends_in_dots, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.concat(folded, tail), "/")

    bare = F.regexp_replace(path, "^/", "")
    return F.when(
        path.rlike(r"(^|/)\.\.?(/|$)"), js.let(F.split(bare, "/"), fold)
    ).otherwise(bare)


def web_href(url: Column) -> Column:
    """An absolute URL in normal form, or null where the text is no URL.

    Covers scheme and host case, default ports, an empty path, back slashes, blanks, non-ASCII
    text and dot segments of web URLs; other schemes keep their text.
    """

    def build(t: Column, scheme: Column, host: Column, path: Column) -> Column:
        tail = F.concat(F.regexp_extract(t, _WEB, 4), F.regexp_extract(t, _WEB, 5))
        rest = F.replace(F.concat(_fold_dots(path), tail), F.lit(" "), F.lit("%20"))
        port = F.when(scheme == "http", F.lit(":(80)?$")).otherwise(F.lit(":(443)?$"))
        return F.when(
            ~host.rlike(r"[\s<>^|%\[\]]"),
            F.concat(
                scheme, F.lit("://"), F.regexp_replace(host, port, F.lit("")), F.lit("/"),
                js.let(rest, _ascii),
            ),
        )

    def of_text(t: Column) -> Column:
        parts = F.struct(
            F.lower(F.regexp_extract(t, _WEB, 1)).alias("scheme"),
            F.lower(F.regexp_extract(t, _WEB, 2)).alias("host"),
            F.translate(F.regexp_extract(t, _WEB, 3), "\\", "/").alias("path"),
        )
        web = js.let(parts, lambda p: build(t, p["scheme"], p["host"], p["path"]))
        return F.when(t.rlike(_WEB), web).when(t.rlike(_OTHER), t)

    return js.let(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]", ""), of_text)
