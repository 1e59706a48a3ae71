"""Operator 5: main text of web pages by the line-block distribution.

Markup is stripped so that every block element is a line; parts of a page
that are never article text (scripts, menus, forms, ...) leave an empty gap
of several lines.  A line weighs its text outside links.  The sum of weights
over a sliding window of lines is the distribution: it surges where text
begins and dives to zero in a gap.  Text between a surge and its dive is
kept if the surge reaches a share of the page's highest or has at least as much
text outside links as in them.  Article elements are a prior: a gap surrounds each,
links inside weigh as text, and where no surge outside of them is higher than the
highest inside, the surges inside are the page's text, all of them.

Cases: null and empty html and pages without text give an empty string; html
of any length is read whole; unclosed and unknown elements are read on;
repeated rows are extracted each; no rows give no rows; the other columns
named in ``extract`` pass through.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

WINDOW = 3          # lines summed
SURGE = 0.25        # of the page's highest window, from where a surge counts whatever its links

_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|select)\b[^>]*>.*?(?:</\1\s*>|\Z)"
                  r"|<head\b[^>]*>.*?(?:</head\s*>|(?=<body\b)|\Z)|<[!?][^>]*>", re.S | re.I)
_TAG = re.compile(r"""<(/?)([a-zA-Z][\w:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][\w:-]*+)([^>]*+)>""")
_ATTR = re.compile(r"""([\w-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_OPEN_END = re.compile(r"<[a-zA-Z/!][^>]*\Z")
_SPACE = re.compile(r"\s+")

# Element names that break a line.
_BLOCK = frozenset("""
address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th
thead title tr ul
""".split())
# Elements that never hold article text.
_SKIP = frozenset("nav footer aside form button input label dialog menu object embed audio video canvas".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Words in class or id, and roles, of parts that are not article text.
_SKIP_WORDS = frozenset("""
ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright
disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo
promotion related reply respond share sharing sidebar social sponsor sponsored subscribe toolbar widget
""".split())
# Those whose parts go even where they hold article elements of their own.
_OTHERS_WORDS = frozenset("comment comments disqus related reply respond".split())
_SKIP_ROLES = frozenset("alert banner complementary contentinfo dialog form menu navigation search".split())
_KEEP = frozenset(["html", "body", "article", "main"])


def _boilerplate(name: str, attrs: str, in_article: bool) -> bool:
    if name in _SKIP:
        return True
    if name == "header":
        return not in_article
    if name in _KEEP or not attrs.strip():
        return False
    for key, *values in _ATTR.findall(attrs):
        key, value = key.lower(), next((v for v in values if v), "").lower()
        if key in ("class", "id"):
            words = set(re.split(r"[^a-z0-9]+", value))
            if words & _SKIP_WORDS or (not in_article and "header" in words):
                return True
        elif key == "role" and value in _SKIP_ROLES:
            return True
        elif key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", re.sub(_ATTR, " ", attrs)))


def _by_others(attrs: str) -> bool:
    named = [next((v for v in values if v), "").lower() for key, *values in _ATTR.findall(attrs) if key.lower() in ("class", "id")]
    return any(set(re.split(r"[^a-z0-9]+", value)) & _OTHERS_WORDS for value in named)


def lines(page: str) -> tuple[list[str], list[int], list[bool] | None]:
    """Lines of a page, the weight of each, and whether it is inside an article element
    (None: the page has none)."""
    page = _OPEN_END.sub("", _RAW.sub("", page))
    tags = [(m.start(), m.end(), bool(m[1] or m[4]), (m[2] or m[5]).lower(), m[3] or m[6] or "") for m in _TAG.finditer(page)]
    # where each container ends: the end tag that balances it
    close, open_at = {}, {}
    for i, (_, _, end, name, attrs) in enumerate(tags):
        if name in _VOID or attrs.endswith("/"):
            continue
        if not end:
            open_at.setdefault(name, []).append(i)
        elif open_at.get(name):
            close[open_at[name].pop()] = i
    marks = [i for i, t in enumerate(tags) if t[3] in ("article", "main") and not t[2] and i in close]
    articles = [i for i in marks if tags[i][3] == "article"] or marks
    out, weights, marked, text, weight = [], [], [], [], 0
    link, inside, until, at, ends = 0, 0, -1, 0, []

    def end_line(gap: bool = False) -> None:
        nonlocal weight
        line = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        text.clear()
        if line:
            out.append(line)
            weights.append(weight)
            marked.append(bool(inside))
        weight = 0
        if gap:
            out.extend([""] * WINDOW)
            weights.extend([0] * WINDOW)
            marked.extend([False] * WINDOW)

    for i, (start, stop, end, name, attrs) in enumerate(tags):
        if i <= until:
            at = stop
            continue
        piece = page[at:start]
        at = stop
        if piece:
            text.append(piece)
            if not link or inside:
                weight += len(piece.strip())
        if not end and i in close and _boilerplate(name, attrs, bool(inside)) \
                and (_by_others(attrs) or not any(i < j < close[i] for j in articles)):
            end_line(gap=True)
            until = close[i]
            continue
        if i in articles or ends and i == ends[-1]:
            end_line(gap=True)
            if end:
                ends.pop()
                inside -= 1
            else:
                ends.append(close[i])
                inside += 1
        elif name == "br":
            text.append(" ")
        elif name == "a":
            link = max(0, link + (-1 if end else 1)) if i in close or end else link
        elif name in _BLOCK:
            end_line()
    rest = page[at:]
    if rest.strip():
        text.append(rest)
        weight += len(rest.strip())
    end_line()
    return out, weights, marked if articles else None


def main_text(page: str | None, window: int = WINDOW, surge: float = SURGE) -> str:
    out, weights, marked = lines(page or "")
    n = len(out)
    if not any(weights):
        return "\n\n".join(x for x in out if x)
    total = [0]
    for w in weights:
        total.append(total[-1] + w)
    # the window over line i looks to both sides, so it is zero only in a gap
    half = window // 2
    level = [total[min(n, i + half + 1)] - total[max(0, i - half)] for i in range(n)]
    surges, i = [], 0                       # (first line, dive, peak, inside an article)
    while i < n:
        if level[i] == 0:
            i += 1
            continue
        dive = i
        while dive < n and level[dive] > 0:
            dive += 1
        surges.append((i, dive, max(level[i:dive]), marked is not None and any(marked[i:dive])))
        i = dive
    highest = max(peak for _, _, peak, _ in surges)
    if any(inside and peak == highest for _, _, peak, inside in surges):
        chosen = [(i, dive) for i, dive, _, inside in surges if inside]
    else:
        links = lambda i, dive: sum(max(0, len(out[j]) - weights[j]) for j in range(i, dive))
        chosen = [(i, dive) for i, dive, peak, _ in surges
                  if peak >= max(1, surge * highest) or total[dive] - total[i] >= links(i, dive)]
    return "\n\n".join(out[j] for i, dive in chosen for j in range(i, dive) if out[j])


def extract(pages: DataFrame, html_col: str = "html", keep: Sequence[str] = ("page_id", "url"), out: str = "text") -> DataFrame:
    """``keep``, then ``out`` (the main text) and ``n_chars`` (its code points)."""
    picked = pages.select(*keep, F.col(html_col).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(h) for h in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*keep, out, "n_chars"])

    return picked.mapInArrow(run, StructType([*picked.schema.fields[:-1], StructField(out, StringType()), StructField("n_chars", LongType())]))
