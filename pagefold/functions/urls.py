"""URL helpers (P13-P17, P19-P21), all built-in expressions.

``resolve_url`` is RFC 3986 reference resolution with the results of
``urllib.parse.urljoin``: one pattern takes a URL apart, and dot segments are
removed by a fold over the path's segments that keeps a stack.
"""

from __future__ import annotations

import mimetypes
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from urllib import parse

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import DEFAULT_MIME


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# [scheme:][//netloc]path[?query][#fragment]
_PARTS = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


# the two commonest references need no taking apart: whole URLs stay as they are, paths from the root follow the
# scheme and host of a plain base
_HOST = r"https?://[A-Za-z0-9._~%@:+\-]+"
_REST = r"(?:\?[^#\t\r\n]+)?(?:#[^\t\r\n]+)?\z"
_WHOLE = rf"^{_HOST}(?:/[^;?#\t\r\n]*)?{_REST}"
_FROM_ROOT = rf"^(?![^?#]*/\.{{1,2}}(?:[/?#]|\z))/(?!/)[^;?#\t\r\n]*{_REST}"
_ORIGIN = rf"^({_HOST})(?:[/?#]|\z)"


@lru_cache(maxsize=1)
def _bracketed_host() -> str:
    """Pattern of what may stand in brackets: an IPv6 address (by the grammar of RFC 3986, with a zone) or IPvFuture."""
    h = "[0-9a-fA-F]{1,4}"
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    tail = rf"(?:{h}:{h}|{octet}(?:\.{octet}){{3}})"
    forms = [f"(?:{h}:){{6}}{tail}", f"::(?:{h}:){{5}}{tail}"]
    for before in range(7):
        after = [f"(?:{h}:){{{4 - before}}}{tail}", h, ""][max(0, before - 4)]
        forms.append(f"(?:(?:{h}:){{0,{before}}}{h})?::{after}")
    return rf"^(?:(?:{'|'.join(forms)})(?:%[^%]+)?|v[0-9a-fA-F]+\.[^\n]+)\z"


@lru_cache(maxsize=1)
def _host_delimiters() -> str:
    """Pattern of the characters that compatibility normalization turns into a delimiter of URLs."""
    found = [c for c in map(chr, range(128, sys.maxunicode + 1)) if set(unicodedata.normalize("NFKC", c)) & set("/?#@:")]
    return f"[{''.join(found)}]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a ``value`` that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _taken_apart(c: Column, default_scheme: Column) -> Column:
    """``scheme, netloc, path, params, query, fragment`` of a URL and whether its host is ``good``."""
    bare = F.regexp_replace(F.regexp_replace(c, r"^[\x00-\x20]+", ""), r"[\t\r\n]+", "")
    names = ("scheme", "netloc", "path", "query", "fragment")
    raw = _let(bare, lambda u: F.struct(*[F.regexp_extract(u, _PARTS, i + 1).alias(n) for i, n in enumerate(names)]))

    def split_params(g: Column) -> Column:
        scheme = F.when(g["scheme"] == "", default_scheme).otherwise(F.lower(g["scheme"]))
        last = F.substring_index(g["path"], "/", -1)
        at = F.when(scheme.isin(*parse.uses_params), F.instr(last, ";")).otherwise(0)
        keep = F.length(g["path"]) - F.length(last) + at
        host, opened, closed = g["netloc"], g["netloc"].contains("["), g["netloc"].contains("]")
        inside = F.regexp_extract(host, r"\[([^\]]*)", 1).rlike(_bracketed_host())
        good = F.when(opened | closed, opened & closed & inside).otherwise(F.lit(True)) & ~host.rlike(_host_delimiters())
        return F.struct(
            scheme.alias("scheme"), host.alias("netloc"),
            F.when(at > 0, F.left(g["path"], keep - 1)).otherwise(g["path"]).alias("path"),
            F.when(at > 0, F.substr(g["path"], keep + 1)).otherwise("").alias("params"),
            g["query"].alias("query"), g["fragment"].alias("fragment"), good.alias("good"))

    return _let(raw, split_params)


def _merged_path(base: Column, path: Column) -> Column:
    """``path`` behind the directory of ``base``, or from the root, without dot segments."""
    folder = _let(F.split(base, "/", -1), lambda p: F.when(F.element_at(p, -1) == "", p).otherwise(F.slice(p, 1, F.size(p) - 1)))
    # empty segments between the first and the last would double the slashes
    behind = _let(F.concat(folder, F.split(path, "/", -1)),
                  lambda p: F.filter(p, lambda x, i: (x != "") | (i == 0) | (i == F.size(p) - 1)))
    segments = F.when(path.startswith("/"), F.split(path, "/", -1)).otherwise(behind)

    def step(stack: Column, segment: Column) -> Column:
        return (F.when(segment == ".", stack)
                .when(segment == "..", F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))
                .otherwise(F.array_append(stack, segment)))

    def without_dots(p: Column) -> Column:
        folded = F.aggregate(p, F.array().cast("array<string>"), step)
        last = F.when(F.element_at(p, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.when(F.exists(p, lambda x: x.isin(".", "..")), F.concat(folded, last)).otherwise(p)

    return _let(F.array_join(_let(segments, without_dots), "/"), lambda j: F.when(j == "", "/").otherwise(j))


def _put_together(scheme: Column, netloc: Column, path: Column, params: Column, query: Column, fragment: Column) -> Column:
    def tagged(mark: str, c: Column) -> Column:
        return F.when(c == "", "").otherwise(F.concat(F.lit(mark), c))

    whole = _let(F.concat(path, tagged(";", params)), lambda p: (
        F.when(netloc != "", F.concat(F.lit("//"), netloc, F.when((p == "") | p.startswith("/"), "").otherwise("/"), p))
        .when(p.startswith("//") | ((scheme != "") & ((p == "") | p.startswith("/"))), F.concat(F.lit("//"), p)).otherwise(p)))
    return F.concat(F.when(scheme == "", "").otherwise(F.concat(scheme, F.lit(":"))), whole, tagged("?", query), tagged("#", fragment))


def resolve_url(base, ref) -> Column:
    """P20: ``urljoin(base, ref)``; where that refuses a host, ``ref`` as it stands; null for a null ``ref``."""
    base, ref = _col(base), _col(ref)

    def joined(b: Column, r: Column) -> Column:
        own = r["netloc"] != ""
        same = ~own & (r["path"] == "") & (r["params"] == "")
        found = _put_together(
            r["scheme"], F.when(own, r["netloc"]).otherwise(b["netloc"]),
            F.when(own, r["path"]).when(same, b["path"]).otherwise(_merged_path(b["path"], r["path"])),
            F.when(same, b["params"]).otherwise(r["params"]),
            F.when(same & (r["query"] == ""), b["query"]).otherwise(r["query"]), r["fragment"])
        # every scheme with relative references also has a netloc
        usable = b["good"] & r["good"] & (r["scheme"] == b["scheme"]) & r["scheme"].isin(*parse.uses_relative)
        return F.when(usable, found).otherwise(ref)

    both = _let(_taken_apart(base, F.lit("")), lambda b: _let(_taken_apart(ref, b["scheme"]), lambda r: joined(b, r)))
    return (F.when(ref.isNull() | base.isNull() | (base == "") | ref.rlike(_WHOLE), ref).when(ref == "", base)
            .when(ref.rlike(_FROM_ROOT) & base.rlike(_ORIGIN), F.concat(F.regexp_extract(base, _ORIGIN, 1), ref))
            .otherwise(both))


def naive_resolve(ref, base) -> Column:
    """Absolute refs unchanged, else base + "/" + ref without leading
    slashes (one "/" only if base does not end with it)."""
    ref, base = _col(ref), _col(base)
    tail = F.regexp_replace(ref, "^/+", "")
    joined = F.when(base.endswith("/"), F.concat(base, tail)).otherwise(
        F.concat(base, F.lit("/"), tail))
    return F.when(ref.startswith("http://") | ref.startswith("https://"), ref).otherwise(joined)


# urlparse(): [scheme:][//netloc]path[?query][#fragment]
_URL_RE = r"^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)"


def url_path(c) -> Column:
    return F.regexp_extract(_col(c), _URL_RE, 3)


def url_netloc(c) -> Column:
    return F.regexp_extract(_col(c), _URL_RE, 2)


def url_scheme(c) -> Column:
    return F.lower(F.regexp_extract(_col(c), _URL_RE, 1))


def path_extension(path) -> Column:
    """Lower-cased text after the last "." of the path, "" if it has none."""
    p = F.lower(_col(path))
    return F.when(p.contains("."), F.element_at(F.split(p, r"\."), -1)).otherwise(F.lit(""))


def media_id(c) -> Column:
    """First 12 hex chars of md5(url)."""
    return F.substring(F.md5(_col(c)), 1, 12)


def content_hash(content, url) -> Column:
    """First 32 hex chars of sha256(content bytes || url utf-8)."""
    return F.substring(F.sha2(F.concat(_col(content), F.encode(_col(url), "UTF-8")), 256), 1, 32)


@lru_cache(maxsize=1)
def mime_tables() -> tuple[dict[str, str], dict[str, str]]:
    """MIME type by extension, and extension by MIME type, as Python's
    mimetypes has them by default (no files of the machine are read)."""
    known = mimetypes.MimeTypes()
    by_name = known.types_map[True]
    return by_name, {t: known.guess_extension(t) for t in set(by_name.values())}


def mime_from_name(c) -> Column:
    """MIME type by file extension, else application/octet-stream."""
    m = F.create_map(*[F.lit(x) for kv in sorted(mime_tables()[0].items()) for x in kv])
    ext = F.concat(F.lit("."), F.lower(F.regexp_extract(_col(c), r"\.([^./]+)$", 1)))
    return F.coalesce(F.try_element_at(m, ext), F.lit(DEFAULT_MIME))
