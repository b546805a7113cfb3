"""Operator 10: main text of web pages by equivalence-class template deduction.

Tokens of a page are the starts and ends of its containers, an end that is not written included. They are told apart by their role: the path of containers they stand in, with classes and ids; siblings that would have the same role are differentiated by what stands
first inside them, and then by their order. The tokens of one host that occur equally often in each of its pages, that is,
whose occurrence vectors over the host's pages are the same, form an equivalence class. A vector is never gathered: its two 31-bit
sums of hash(page, count) stand for it, and they add up across tasks before a shuffle, so a host with a third of all pages is
a few rows for each task. Classes whose tokens occur once in most of the host's pages, start and end together, are valid; nested by their paths they
make the host's template. What lies between their tokens are its slots; a slot with the same text on every page is part
of the template, the others are what pages fill in.

The article is a slot of the most frequent class of which some container holds most of the host's text that varies from page to page and is
no menu, header, footer, sidebar, notice, advert, form or comments; of that class the deepest such container, article and main elements first. So a
container that only some of the pages have does not decide for the others. Inside it, slots of the template that say the
same on three different pages at least are left out, and so are menus and the like, scripts, styles and markup. A page without that container
falls back to its own article, main or body. Nothing else is dropped: repeated paragraphs stay.

Defined results: null and empty html give an empty text; rows with a null url share a host; html that breaks off is read as
far as it goes; containers count however deep they are nested; repeated rows give repeated rows, and copies of a page count as one page where a slot is
taken for constant; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm._common import map_arrow, written

# Elements by what they do to the text.
CONTAINERS = frozenset("html body div section article main nav header footer aside form ul ol table dl figure center td".split())
RAW = frozenset("script style noscript template svg iframe textarea select button object canvas title head".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li tr th dt dd blockquote pre br hr address caption figcaption details summary option tbody thead tfoot fieldset legend video audio".split())
BOILERPLATE = frozenset("nav footer aside form".split())
# Words of class and id names of parts that are not the article.
PARTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner comment comments reply replies respond disqus sidebar side menu menus nav navbar navigation navi breadcrumb breadcrumbs footer foot masthead notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended widget widgets pagination pager toolbar skip".split())
HEADS = frozenset("header head top".split())

# A tag's attributes: values in quotes, of any length and with any sign; other values; else anything but the signs that end or begin a tag.
_ATTRS = r"(?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=\s*+[^\s<>\"'][^\s<>]*+|=)*+"
# Comments; tags; tags of containers that the next tag cuts off; other markup.
TOKEN = re.compile(rf"<!--.*?(?:--!?>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)({_ATTRS})(?:>|\Z)|<(/?)({'|'.join(sorted(CONTAINERS))})(?![A-Za-z0-9:-])({_ATTRS})(?=<)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
# Raw elements: those that run to the end of the page where no end tag follows; those that hold no tags; the others can be nested.
SCRIPTS, TEXTS = ("script", "style"), ("title", "textarea", "iframe")
TAGS = {name: re.compile(rf"<(/?){name}(?![A-Za-z0-9:-])[^>]*(?:>|\Z)", re.I) for name in TEXTS}
ENDS = {name: re.compile(rf"</{name}(?![A-Za-z0-9:-])[^>]*(?:>|\Z)", re.I) for name in SCRIPTS}
ATTR = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
NAME_WORDS = re.compile(r"[a-z]+")
DIGITS = re.compile(r"\d+")
# Paths of containers nested deeper, and labels of more characters, are written as hashes. Later siblings of one role share one.
MAX_DEPTH, MAX_LABEL, MAX_ORDER = 64, 256, 16


def events(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, value): text, and start and end tags of containers and blocks; raw elements and comments are left out.

    A raw element that is self-closed, or has no end tag of its own, is empty; scripts and styles without one run to the end of the page.
    """
    tags: list[tuple[int, int, str, str, str]] = []  # from, to, kind, name, attributes
    until: dict[int, int] = {}  # of nested raw elements, the tag that ends each
    open_: dict[str, list[int]] = {}
    at = 0
    while m := TOKEN.search(html, at):
        at = m.end()
        name = (m.group(2) or m.group(5) or "").lower()
        kind = "end" if m.group(1) or m.group(4) else "start"
        value = m.group(3) or m.group(6) or ""
        if name in RAW and name != "head":
            if kind == "end":
                if open_.get(name):
                    until[open_[name].pop()] = len(tags)
            elif not value.endswith("/"):
                if name in SCRIPTS:
                    end = ENDS[name].search(html, at)
                    at = end.end() if end else len(html)
                elif name in TEXTS:
                    end = TAGS[name].search(html, at)
                    at = end.end() if end and end.group(1) else at
                else:
                    open_.setdefault(name, []).append(len(tags))
            kind = "raw"
        tags.append((m.start(), at, kind, name, value))
    done = k = 0
    while k < len(tags):
        a, b, kind, name, value = tags[k]
        if a > done:
            yield "text", "", html[done:a]
        k = until.get(k, k)
        done = tags[k][1]
        if name:
            yield kind, name, value
        k += 1
    if done < len(html):
        yield "text", "", html[done:]


def role(name: str, attributes: str) -> tuple[str, bool, bool]:
    """A container's label (name, classes and id without digits); whether it is boilerplate; whether it is the article."""
    return _role(name, attributes) if len(attributes) <= 1000 else _role.__wrapped__(name, attributes)


@lru_cache(maxsize=4096)
def _role(name: str, attributes: str) -> tuple[str, bool, bool]:
    found: dict[str, str] = {}
    for k, a, b, c in ATTR.findall(attributes):
        found.setdefault(k.lower(), (a or b or c).lower())
    names = DIGITS.sub("", f"{found.get('class', '')} {found.get('id', '')}").strip()
    words = set(NAME_WORDS.findall(names))
    main = name in ("article", "main") or found.get("role") in ("main", "article") or "articlebody" in found.get("itemprop", "")
    other = name in BOILERPLATE or found.get("role") in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert") or (not main and bool(words & PARTS))
    return f"{name}.{'.'.join(names.split())}" if names else name, other, main


def is_head(label: str) -> bool:
    name, _, names = label.partition(".")
    return name == "header" or bool(set(NAME_WORDS.findall(names)) & HEADS)


def path_of(up: str, label: str, depth: int) -> str:
    """The path of a container below ``up``: its labels, or below MAX_DEPTH its depth, a hash of them, and its own label."""
    if len(label) > MAX_LABEL:
        label = f"{label.partition('.')[0]}.#{_hash(label)}"
    return f"{up}/{label}" if depth <= MAX_DEPTH else f"/#{depth}#{_hash(up + '/' + label)}/{label}"


def _hash(text: str) -> str:
    return xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass"))


def depth_of(path: str) -> int:
    return int(path[2:].partition("#")[0]) if path.startswith("/#") else path.count("/")


@dataclass(slots=True)
class Node:
    """A container: its label, the one it stands in (-1: none), flags (here or above), what stands first inside, and its path."""

    label: str
    up: int
    depth: int
    other: bool
    main: bool
    first: str = ""
    path: str = ""


def outline(html: str) -> tuple[list[Node], list[tuple[str, int, str]]]:
    """The containers of a page in order, and its content: (kind, container or -1, text), with block breaks as spaces.

    An end tag closes the nearest open container of its name, if there is one; open ones inside it are closed with it.
    """
    nodes: list[Node] = []
    content: list[tuple[str, int, str]] = []
    stack: list[tuple[str, int]] = []
    opened: dict[str, int] = {}
    head = False
    for kind, name, value in events(html):
        here = stack[-1][1] if stack else -1
        if kind == "text":
            if not head:
                content.append(("text", here, value))
                if here >= 0 and not nodes[here].first and not value.isspace():
                    nodes[here].first = "#"
            continue
        if here >= 0 and kind == "start" and not nodes[here].first:
            nodes[here].first = name
        if name == "head":
            head = kind == "start"
        elif kind != "raw" and name in CONTAINERS:
            head = False
            if kind == "start":
                label, other, main = role(name, value)
                up = nodes[here] if here >= 0 else None
                if is_head(label) and not (up and up.main):
                    other = True
                opened[name] = opened.get(name, 0) + 1
                stack.append((name, len(nodes)))
                content.append(("start", len(nodes), ""))
                nodes.append(Node(label, here, len(stack), other or bool(up and up.other), main or bool(up and up.main)))
            elif opened.get(name):
                while True:
                    last, k = stack.pop()
                    opened[last] -= 1
                    content.append(("end", k, ""))
                    if last == name:
                        break
        elif name in BLOCKS:
            head = False
            content.append(("break", here, " "))
    content += (("end", k, "") for _, k in reversed(stack))
    _differentiate(nodes)
    return nodes, content


def _differentiate(nodes: list[Node]) -> None:
    """Paths. Siblings of one label are told apart by what stands first in them; those that still are alike, by their order."""
    alike: dict[tuple[int, str], int] = {}
    for x in nodes:
        alike[x.up, x.label] = alike.get((x.up, x.label), 0) + 1
    order: dict[tuple[int, str], int] = {}
    for x in nodes:
        label = x.label if alike[x.up, x.label] == 1 else f"{x.label}>{x.first}"
        n = order[x.up, label] = order.get((x.up, label), 0) + 1
        x.path = path_of(nodes[x.up].path if x.up >= 0 else "", label if n == 1 else f"{label}[{min(n, MAX_ORDER)}]", x.depth)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url).hostname or "") if url else ""
    except ValueError:
        return ""


PRIME, BASE = 2**61 - 1, 0x9E3779B97F4A7C1 % (2**61 - 1)


def _profile(html: str) -> dict[str, list]:
    """By container path: how often it comes, characters of text inside, hash of that text, flags, and of deep ones the path they stand in.

    The hash is that of a range of the page's texts, from sums up to its two ends, so deep nests take no longer.
    """
    nodes, content = outline(html)
    out: dict[str, list] = {}
    began = [(0, 0)] * len(nodes)
    size, sums, powers = 0, [0], [1]
    for kind, k, value in content:
        if kind == "text":
            flat = "".join(value.split())
            size += len(flat)
            if flat:
                sums.append((sums[-1] * BASE + xxhash.xxh64_intdigest(flat.encode("utf-8", "surrogatepass"))) % PRIME)
                powers.append(powers[-1] * BASE % PRIME)
        elif kind == "start":
            began[k] = size, len(sums) - 1
        elif kind == "end":
            x = nodes[k]
            row = out.setdefault(x.path, [0, 0, 0, x.other, x.main, nodes[x.up].path if x.path.startswith("/#") else ""])
            row[0] += 1
            row[1] += size - began[k][0]
            row[2] = (sums[-1] - sums[began[k][1]] * powers[len(sums) - 1 - began[k][1]]) % PRIME
    return out


def _counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Sums for each host and token of a batch of (key, url, html); the token "" counts the host's pages.

    ``kinds`` has a bit for each of 63 groups of page contents, so pages that differ are told from copies of one.
    """
    rows: dict[tuple[str, str], list] = {}
    for key, url, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
        host = host_of(url)
        content = xxhash.xxh64_intdigest((html or "").encode("utf-8", "surrogatepass"))
        page = f"{key} {content} "
        tokens = {"": (1, 0, 0, False, False, "")}
        for path, (n, chars, text, other, main, up) in _profile(html or "").items():
            tokens["+" + path], tokens["-" + path] = (n, chars, text, other, main, up), (n, 0, 0, other, main, up)
        for token, (n, chars, text, other, main, up) in tokens.items():
            h = xxhash.xxh64_intdigest(f"{page}{n}")
            row = rows.setdefault((host, token), [0, 0, 0, 0, 0, text >> 1, text >> 1, 0, other, main, up])
            row[0] += 1
            row[1] += n == 1
            row[2] += h & 0x7FFFFFFF
            row[3] += h >> 33
            row[4] += chars
            row[5], row[6] = min(row[5], text >> 1), max(row[6], text >> 1)
            row[7] |= 1 << content % 63
    names = ["pages", "once", "v1", "v2", "chars", "low", "high", "kinds", "other", "main", "up"]
    cols = [*zip(*rows.values(), strict=True)] or [[]] * 11
    arrays = [pa.array(c, pa.int64() if k < 8 else pa.bool_() if k < 10 else pa.string()) for k, c in enumerate(cols)]
    return pa.record_batch([pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.string()), *arrays], names=["host", "token", *names])


def templates(pages: DataFrame, support: float = 0.6) -> DataFrame:
    """(``host``, ``template``): JSON of the valid tokens of each host with their equivalence class.

    ``support``: the share of a host's pages in which a valid token occurs, once in most of them.
    """
    kinds = "host string, token string, pages bigint, once bigint, v1 bigint, v2 bigint, chars bigint, low bigint, high bigint, kinds bigint, other boolean, main boolean, up string"
    sums = map_arrow(pages, [F.col("key"), F.col("url"), F.col("html")], _counts, kinds)
    added = [F.sum(c).alias(c) for c in ("pages", "once", "v1", "v2", "chars")]
    tokens = sums.groupBy("host", "token").agg(*added, F.min("low").alias("low"), F.max("high").alias("high"), F.bit_or("kinds").alias("kinds"), F.bool_or("other").alias("other"), F.bool_or("main").alias("main"), F.max("up").alias("up"))
    tokens = written(tokens, "page-tokens")
    hosts = tokens.where("token = ''").select("host", F.col("pages").alias("all"))
    # At most 1 / support times the tokens of a page are left for a host. Deep containers that are not valid stay, marked, as steps up.
    often = tokens.where("token <> ''").join(hosts, "host").where(F.col("pages") >= support * F.col("all"))
    deep, once, varies = F.col("token").startswith("+/#"), F.col("once") >= 0.8 * F.col("pages"), F.col("low") != F.col("high")
    constant = ~varies & (F.bit_count("kinds") >= 3) & (F.col("chars") > 0)
    classed = often.where(once | deep).select("host", F.struct("token", F.concat_ws(":", "pages", "v1", "v2").alias("cls"), "pages", "chars", varies.alias("varies"), constant.alias("constant"), "other", "main", F.when(deep, F.col("up")).alias("up"), F.when(~once, True).alias("step")).alias("t"))
    return classed.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list("t"))).alias("template"))


@lru_cache(maxsize=2048)
def slots(template: str | None) -> tuple[str | None, frozenset[str]]:
    """Of a host's template: the container whose inside is the article, and the constant ones inside it."""
    every = json.loads(template) if template else []
    ends = {t["token"][1:]: t["cls"] for t in every if t["token"][0] == "-"}
    rows = [t | {"token": t["token"][1:]} for t in every if t["token"][0] == "+"]
    up = {t["token"]: t["up"] for t in rows if t.get("up")}
    rows = [t for t in rows if not t.get("step") and ends.get(t["token"]) == t["cls"]]

    def within(t: dict, u: dict) -> bool:
        """Whether the container of token ``t`` stands in that of ``u``."""
        a, b = t["token"], u["token"]
        if b.startswith("/#"):
            least = depth_of(b)
            while a in up and depth_of(a) > least:
                a = up[a]
            return a == b and t["token"] != u["token"]
        while a in up:
            a = up[a]
        return a.startswith(b + "/") or (a == b and t["token"] != u["token"])

    starts = [t for t in rows if not t["other"]]
    # Elements that say they are the article: the innermost kind, if the template has it.
    named = [t for t in starts if t["main"]]
    pool = [t for t in named if t["token"].rpartition("/")[2].startswith("article")]
    pool = pool or [t for t in named if not any(u is not t and within(t, u) for u in named)]
    pool = pool or [t for t in starts if t["varies"]] or starts
    if not pool:
        return None, frozenset()
    # Characters that vary: those of a container less its outermost constant and boilerplate parts.
    rest = [t for t in rows if t["other"] or not t["varies"]]
    rest = [t for t in rest if not any(within(t, u) for u in rest)]
    own = {t["token"]: t["chars"] - sum(u["chars"] for u in rest if within(u, t)) for t in pool}
    most = max(own.values())
    large = [t for t in pool if own[t["token"]] >= 0.7 * most]
    # The most frequent class that has such a container, the larger one of equals; of its containers the deepest.
    members = Counter(t["cls"] for t in rows)
    cls = max((t["pages"], members[t["cls"]], t["cls"]) for t in large)[2]
    best = max((t for t in large if t["cls"] == cls), key=lambda t: (depth_of(t["token"]), own[t["token"]], t["token"]))
    constant = frozenset(t["token"] for t in rows if t["constant"] and not t["main"] and within(t, best)) if best["varies"] else frozenset()
    return best["token"], constant


def main_text(html: str, path: str | None, constant: frozenset[str] = frozenset()) -> str:
    """Text of the article slot of a page, without the ``constant`` slots and the boilerplate inside it."""
    nodes, content = outline(html)
    if not any(x.path == path for x in nodes):
        path, constant = next((x.path for x in nodes if x.main and not x.other), None), frozenset()
    out: list[str] = []
    inside, left_out = 0 if path else 1, 0
    for kind, k, value in content:
        if kind in ("start", "end"):
            step = 1 if kind == "start" else -1
            inside += step * (nodes[k].path == path)
            left_out += step * (nodes[k].path in constant)
            out.append(" ")
        elif inside and not left_out and (kind == "break" or k < 0 or not nodes[k].other):
            out.append(value)
    return " ".join(entities.unescape("".join(out)).split())


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", salts: int = 16, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """Per row: ``id_col``, ``url_col``, ``text``, ``n_chars``.

    Templates of up to ``broadcast_bytes`` together go to every task; more are joined, with hosts dealt out over ``salts`` keys.
    """
    pages = df.select(df[id_col].alias("key"), df[url_col].alias("url"), df[html_col].alias("html"))
    known = written(templates(pages), "templates")
    host = F.coalesce(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^:/?#]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#\[]*)", 1)), F.lit(""))
    rows = pages.withColumn("host", F.regexp_replace(host, r"[\[\]]", ""))
    if (known.agg(F.sum(F.length("template") + F.length("host"))).first()[0] or 0) <= broadcast_bytes:
        joined = rows.join(F.broadcast(known), "host", "left")
    else:
        dealt = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("key", "url"), F.lit(salts)).cast("int")).join(dealt, ["host", "salt"], "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        html, template = (batch.column(k).to_pylist() for k in (2, 3))
        text = [main_text(h, *slots(t)) if h else "" for h, t in zip(html, template, strict=True)]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([*map(len, text)], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(joined, [F.col("key"), F.col("url"), F.col("html"), F.col("template")], run, f"{id_col} {kind}, {url_col} string, text string, n_chars bigint")
