"""Main text of web pages by consensus host paths.

Every page's containers get a score: characters of text of their own paragraphs, less those inside links, with tags and class or id
words that name surroundings (menus, adverts, comments and such) left out altogether. A container is known by its path of
generalised tags and classes (digits folded, positions dropped). Pages vote with their scores for the paths they have, votes are
summed per host and path in Spark, and the path with the most votes is the host's. Then each page is extracted again under its host's path.

The path is climbed to whatever else holds the article: to the outermost article or main around it, then to the outermost container that adds
a headline (h1), text of its own (the body excepted), or ``ADDS`` of its text by other containers. That last step is decided by most of the
host's pages that have it. Outside the article or main, blocks mostly of links are left out. A page falls back on its own best container, climbed in the same way on
the page alone, if it lacks its host's path, or if that holds less than ``SMALL`` of the page's best score; the latter not if its best container is
one that stands on a hundredth of the host's pages or more and is best on less than half of those that have it (a sidebar).

The hot side of the vote is summed before it is shuffled and written once, a row a host and path. The chosen paths, one row a host, meet the pages
by host and a salt of ``salts`` values, so that a host with a third of all pages is spread.

Defined results: a null or empty page has an empty text, also one without any container with text. Character references are decoded, blanks inside a
block become one blank, blocks are joined by one line end in page order. Broken markup is read as it comes: unclosed tags end with
their parent, an unclosed comment, script or style reaches to the end. A null or odd url counts as a host of its own (empty). Repeated pages vote as often as
they come and each comes back. Other columns pass through untouched.
"""
import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from evalspark.llm.shared import kept

SALTS = 16
ADDS, SMALL = 0.05, 0.25
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
                    r"|<[!?][^>]*>|<(/?)([a-zA-Z][^\s>/]*)([^>]*)>", re.S | re.I)
_WORDS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
BLOCKS = frozenset("p div article section main h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table tr td th blockquote pre figure figcaption header footer nav "
                   "aside form body html fieldset address details summary center hr".split())
CONTAINERS = frozenset("article main section div td body blockquote".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SURROUNDINGS = frozenset("nav header footer aside form button dialog menu".split())
_SIGNS = re.compile(r"(?:^|[-_\s])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|side-?bar\w*|widget\w*|footer\w*|header\w*|"
                    r"comments?|commentlist|disqus|repl(?:y|ies)|cookies?|notices?|consent|gdpr|popup|modal|newsletter|subscribe|signup|login|share|"
                    r"sharing|social|related|recommend\w*|pagination|pager|search\w*|toolbar|masthead|complementary|contentinfo|navigation|alert)(?:$|[-_\s\d])", re.I)
_BLANKS = re.compile(r"\s+")
#: An element's start closes these open ones, as HTML lets their end tags be left out.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def label_of(tag: str, attributes: str) -> tuple[str, bool]:
    """Generalised name of an element, and whether it names surroundings of the article."""
    words = " ".join(a or b or c for a, b, c in _WORDS.findall(attributes)) if attributes else ""
    out = tag in SURROUNDINGS or bool(words and tag not in ("body", "html", "article", "main") and _SIGNS.search(words))
    name = ".".join([tag, *sorted(set(re.sub(r"\d+", "0", words).lower().split()))]) if words else tag
    return name, out


def blocks_of(page: str) -> Iterator[tuple[tuple[str, ...], str, int, bool]]:
    """(path of the containers around it, text, characters in links, is headline) of each block of text outside surroundings, in page order."""
    stack: list[tuple[str, str, bool]] = []  # tag, label, is surroundings
    hidden = linked = 0
    parts: list[str] = []
    link_chars = 0

    def path():
        return tuple(label for tag, label, _ in stack if tag in CONTAINERS)

    def flush():
        nonlocal link_chars
        text = _BLANKS.sub(" ", _html.unescape("".join(parts))).strip() if parts else ""
        done = (path(), text, link_chars, any(tag == "h1" for tag, _, _ in stack)) if text else None
        parts.clear()
        link_chars = 0
        return done

    def pop(to: int):
        nonlocal hidden, linked
        for tag, _, out in stack[to:]:
            hidden -= out
            linked -= tag == "a"
        del stack[to:]

    def text(piece: str):
        nonlocal link_chars
        if piece and not hidden:
            parts.append(piece)
            if linked:
                link_chars += len(piece)
    at = 0
    for m in _TOKEN.finditer(page):
        text(page[at:m.start()])
        at = m.end()
        tag = m.group(3)
        if not tag:
            continue
        tag = tag.lower()
        if tag in BLOCKS and (done := flush()):
            yield done
        if m.group(2):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
        elif tag == "br":
            text(" ")
        elif tag not in VOID and not m.group(4).endswith("/"):
            if tag in BLOCKS:  # a paragraph, with what it has open inside, ends where a block begins
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        pop(i)
                        break
                    if stack[i][0] in BLOCKS:
                        break
            for i in range(len(stack) - 1, -1, -1) if tag in _CLOSES else ():
                if stack[i][0] in _CLOSES[tag]:
                    pop(i)
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "select"):
                    break
            name, out = label_of(tag, m.group(4))
            stack.append((tag, name, out))
            hidden += out
            linked += tag == "a"
    text(page[at:])
    if done := flush():
        yield done


def _worth(text: str, link_chars: int) -> float:
    return float(max(len(text) - 2 * link_chars, 0))


def _scores(blocks: list) -> tuple[dict[tuple[str, ...], float], dict[tuple[str, ...], float]]:
    """Score of each container path (text of its own blocks fully, of blocks further down less by level; links count against it), and its whole text."""
    out: dict[tuple[str, ...], float] = {}
    whole: dict[tuple[str, ...], float] = {}
    for path, text, link_chars, _ in blocks:
        worth = full = _worth(text, link_chars)
        for depth in range(len(path), 0, -1):
            out[path[:depth]] = out.get(path[:depth], 0.0) + worth
            whole[path[:depth]] = whole.get(path[:depth], 0.0) + full
            worth *= 0.7 if path[depth - 1].split(".")[0] != "article" else 0.3
    return out, whole


def scores_of(page: str) -> dict[tuple[str, ...], float]:
    return _scores(list(blocks_of(page)))[0]


def _best(scores: dict[tuple[str, ...], float]) -> tuple[str, ...]:
    return max(scores, key=lambda p: (scores[p], len(p), p)) if scores else ()


def best_path(page: str) -> tuple[str, ...]:
    return _best(scores_of(page))


def _much(whole: dict[tuple[str, ...], float], child: tuple[str, ...]) -> bool:
    """Whether containers beside the child hold ADDS of its parent's text."""
    parent = whole.get(child[:-1], 0.0)
    return parent > 0 and parent - whole.get(child, 0.0) >= ADDS * parent


def climbed(blocks: list, path: tuple[str, ...], whole: dict[tuple[str, ...], float] | None = None) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(article or main around the path, or the path; outermost container that adds text to it); by ``whole`` also what other containers add."""
    base = next((path[:i] for i in range(1, len(path)) if path[i - 1].split(".")[0] in ("article", "main")), path)
    for i in range(1, len(base)):
        outer, inner = base[:i], base[:i + 1]
        if whole is not None and _much(whole, inner):
            return base, outer
        for own, text, link_chars, top in blocks:
            if own[:i] == outer and own[:i + 1] != inner and (top or own == outer and outer[-1].split(".")[0] != "body") and _worth(text, link_chars):
                return base, outer
    return base, base


def main_text(page: str, host_path: tuple[str, ...], host_outer: tuple[str, ...], beside: frozenset = frozenset()) -> str:
    """Text of a page under its host's path, or under its own; host_outer: the container up to which the host's pages climb."""
    blocks = list(blocks_of(page))
    scores, whole = _scores(blocks)
    own = _best(scores)
    use = host_path if host_path in scores else host_outer if host_outer in scores else ()
    if use and max(scores.get(host_path, 0.0), scores.get(host_outer, 0.0)) < SMALL * scores[own] and own not in beside:
        use = ()
    if use:
        base, outer = climbed(blocks, use)
        outer = min(outer, host_outer, key=len)
    else:
        base, outer = climbed(blocks, own, whole)
    if not outer:
        return ""
    return "\n".join(text for path, text, link_chars, _ in blocks
                     if path[:len(outer)] == outer and (path[:len(base)] == base or _worth(text, link_chars)))


def host_votes(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(host, path, votes, pages, best, adds): scores by host and path, pages that have it, on which it is best, and on which containers beside it
    hold ADDS of its parent's text; those of a task summed before they are shuffled. The row without a path counts the host's pages."""
    def run(batches):
        for b in batches:
            sums: dict[tuple[str, str], list] = {}
            for host, page in zip(b.column(0).to_pylist(), b.column(1)):
                scores, whole = _scores(list(blocks_of(page.as_py() or "")))
                own = _best(scores)
                for path, score in [((), 0.0), *scores.items()]:
                    row = sums.setdefault((host, ">".join(path)), [0.0, 0, 0, 0])
                    row[0] += score
                    row[1] += 1
                    row[2] += path == own
                    row[3] += len(path) > 1 and _much(whole, path)
            columns = [[k[0] for k in sums], [k[1] for k in sums], *([r[i] for r in sums.values()] for i in range(4))]
            types = [pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["host", "path", "votes", "pages", "best", "adds"])
    rows = pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "host string, path string, votes double, pages bigint, best bigint, adds bigint").groupBy("host", "path").agg(
        *[F.sum(c).alias(c) for c in ("votes", "pages", "best", "adds")])


def host_paths(votes: DataFrame) -> DataFrame:
    """(host, _host_path, _host_outer, _beside): the path with the most votes, how far the host's pages climb, containers that are seldom best."""
    winners = votes.groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("_host_path"), F.max("pages").alias("_all"))
    around = F.startswith(F.concat("_host_path", F.lit(">")), F.concat("path", F.lit(">"))) & (F.col("adds") * 2 > F.col("pages"))
    aside = (F.col("path") != "") & (F.col("pages") * 100 >= F.col("_all")) & (F.col("best") * 2 < F.col("pages"))
    notes = votes.join(winners, "host").where(around | aside | (F.col("path") == F.col("_host_path")))
    return notes.groupBy("host").agg(
        F.first("_host_path").alias("_host_path"),
        F.coalesce(F.min_by(F.when(around, F.regexp_replace("path", ">[^>]*$", "")), F.when(around, F.length("path"))), F.first("_host_path")).alias("_host_outer"),
        F.collect_list(F.when(aside, F.col("path"))).alias("_beside"))


def host_of(url_col: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url", out: str = "text", salts: int = SALTS) -> DataFrame:
    """pages with the main text."""
    chosen = ["_host_path", "_host_outer", "_beside"]
    winners = host_paths(kept(host_votes(pages, html_col, url_col), "votes"))
    spread = winners.select(F.col("host").alias("_path_host"), *chosen, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_path_salt"))
    salted = pages.withColumn("_page_host", host_of(url_col)).withColumn("_page_salt", F.pmod(F.xxhash64(url_col, html_col), F.lit(salts)).cast("int"))
    joined = salted.join(spread, (F.col("_page_host") == F.col("_path_host")) & (F.col("_page_salt") == F.col("_path_salt")), "left").select(*pages.columns, *chosen)

    def run(batches):
        for b in batches:
            names = b.schema.names
            texts = []
            known: dict[tuple, tuple] = {}
            for page, *host in zip(b.column(names.index(html_col)), *(b.column(names.index(c)).to_pylist() for c in chosen)):
                key = (host[0], host[1], tuple(host[2] or ()))
                if key not in known:
                    known[key] = (*(tuple(p.split(">")) if p else () for p in host[:2]), frozenset(tuple(p.split(">")) for p in key[2]))
                texts.append(main_text(page.as_py() or "", *known[key]))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i, n in enumerate(names) if n not in chosen], pa.array(texts, pa.string())],
                                             [*[n for n in names if n not in chosen], out])
    return joined.mapInArrow(run, StructType([*pages.schema.fields, StructField(out, StringType())]))
