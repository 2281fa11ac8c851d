"""Main text of web pages by line-block distribution.

The markup is stripped to one line per block; what stands in menus, forms,
scripts and the like gives empty lines. The text lengths of sliding windows of
lines are summed up; the main text begins where a window surges over a limit
and ends where it dives to nothing. Text in <article> or <main> weighs more, no
page is decided by a tag alone.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
#: characters of a window at which a text begins, at most
SURGE = 80
#: a character in an article or main counts as so many in a window
MARK = 4
#: an element with a boilerplate name that holds more of the page's text is a wrapper
MOST = 0.8

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "select", "title", "canvas", "audio", "video"}
_SKIP = _RAW | {"head", "nav", "footer", "aside", "form", "button", "dialog", "menu"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby",
           "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "input"}
_HINTS = set("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices
 alert popup modal overlay menu nav navbar navigation navi breadcrumb breadcrumbs sidebar widget widgets footer masthead topbar toolbar comment comments
 reply replies disqus respond share sharing social related recommended newsletter subscribe signup login pagination pager hidden
 site-header page-header top-bar tool-bar site-footer page-footer site-nav site-navigation main-nav main-navigation main-menu nav-bar nav-menu nav-links
 post-navigation side-bar comments-area comment-list comment-form related-posts related-articles related-stories share-buttons social-links social-media
 cookie-banner cookie-notice cookie-consent newsletter-signup ad-container ad-banner ad-slot""".split())
#: hints that hold for nothing beside a name of the text itself
_WEAK = {"widget", "widgets"}
_TEXT = {"article", "content", "entry", "main", "post", "story"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "alertdialog"}
_BODY = {"html", "body", "article", "main"}
_CLOSE = {"script": re.compile(r"</script[^>]*>", re.I), "style": re.compile(r"</style[^>]*>", re.I)}


def _boilerplate(name: str, attrs: str, in_article: bool) -> tuple[bool, bool]:
    """(certainly, by its name only): the latter is a form, class or id and does
    not hold for a wrapper."""
    if name in _SKIP and name != "form" or name == "header" and not in_article:
        return True, False
    named = name == "form"
    if name in _BODY or not attrs.strip():
        return False, named
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True, False
        if key == "role" and value in _ROLES:
            if value != "form":
                return True, False
            named = True
        if key in ("class", "id"):
            names = set(value.replace("_", "-").split())
            hints = names & _HINTS
            if hints and not (hints <= _WEAK and names & _TEXT) or "header" in names and not in_article and not names & {"article", "post", "entry"}:
                named = True
    return False, named


def lines_of(html: str) -> list[tuple[str, int, bool]]:
    """(text, characters outside links, inside article or main) per block; a
    boilerplate block is an empty line."""
    lines, text, plain = [], [], [0]
    none = ("", False, False, False, 0)
    stack: list[tuple[str, bool, bool, bool, int]] = []  # name, skipped, in a link, in the article, innermost named element
    above, held = [0], [0]  # of the named elements, 0 is the page: the next one outside, characters

    def flush(state):
        line = " ".join("".join(text).split())
        if line:
            lines.append(("", 0, state[3], 0) if state[1] else (line, plain[0], state[3], state[4]))
            held[state[4]] += 0 if state[1] else len(line) - line.count(" ")
        text.clear()
        plain[0] = 0

    def add(s, state):
        if s:
            s = unescape(s)
            text.append(s)
            if not state[1] and not state[2]:
                plain[0] += len("".join(s.split()))

    at, top = 0, none
    while m := _TOKEN.search(html, at):
        add(html[at:m.start()], top)
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name == "br":
            text.append(" ")
            continue
        if name not in _INLINE:
            flush(top)
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            top = stack[-1] if stack else none
            continue
        if name in _VOID or m[3].endswith("/"):
            continue
        if name in ("p", "li", "dt", "dd", "option", "tr", "td", "th") and stack and stack[-1][0] == name:
            stack.pop()
            top = stack[-1] if stack else none
        skip, named = _boilerplate(name, m[3], top[3])
        if named:
            if name in _INLINE:  # what stands before is not in it
                flush(top)
            above.append(top[4])
            held.append(0)
        top = (name, top[1] or skip, top[2] or name == "a", top[3] or name in ("article", "main"), len(held) - 1 if named else top[4])
        stack.append(top)
        if name in _CLOSE:  # nothing inside is markup
            end = _CLOSE[name].search(html, at)
            at = end.end() if end else len(html)
            stack.pop()
            top = stack[-1] if stack else none
    add(html[at:] if "<" not in html[at:at + 1] else "", top)
    flush(top)
    for k in range(len(held) - 1, 0, -1):
        held[above[k]] += held[k]
    gone = [False] * len(held)
    for k in range(1, len(held)):
        gone[k] = gone[above[k]] or held[k] <= MOST * held[0]
    return [("", 0, a) if gone[k] else (t, p, a) for t, p, a, k in lines]


def _surges(weight: list[int], part: list[bool], size: list[int]) -> list[list[int]]:
    """The lines from each surge to its dive that weigh, and lines of links that
    stand alone between two such lines; no window and no text goes on where
    ``part`` changes."""
    n = len(weight)
    stop = [n] * (n + 1)
    for i in range(n - 2, -1, -1):
        stop[i] = stop[i + 1] if part[i] == part[i + 1] else i + 1
    block = [sum(weight[i:min(i + WINDOW, stop[i])]) for i in range(n)]
    limit = min(SURGE, max(block, default=0) / 2)
    out, i = [], 0
    while i < n:
        if not weight[i] or block[i] <= limit:
            i += 1
            continue
        end, run = stop[i], []
        while i < end and block[i]:  # from the surge to the dive
            if weight[i] or size[i] and run and run[-1] == i - 1 and i + 1 < end and weight[i - 1] and weight[i + 1]:
                run.append(i)
            i += 1
        out.append(run)
    return out


def main_text(html: str) -> str:
    """The blocks between surge and dive, joined by a line feed.

    A line weighs as many characters as it has outside links; a line that is
    mostly links weighs nothing, and stays only if it stands alone between two
    that weigh. The surge is SURGE characters in WINDOW lines,
    or half the page's largest window if that is less; the dive is WINDOW lines
    without text. In an article or main all characters count, MARK times. If
    what surges there is at least as long as the largest text outside, it is
    the main text; else the page is taken as one without these marks."""
    lines = lines_of(html)
    size = [len(t) - t.count(" ") for t, _, _ in lines]
    weight = [s if 2 * plain > s else 0 for s, (_, plain, _) in zip(size, lines, strict=True)]
    inside = [a for _, _, a in lines]
    if any(a and s for a, s in zip(inside, size, strict=True)):
        more = [MARK * s if a else w for s, w, a in zip(size, weight, inside, strict=True)]
        runs = _surges(more, inside, size)
        marked = [r for r in runs if inside[r[0]]]
        if sum(size[i] for r in marked for i in r) >= max((sum(more[i] for i in r) for r in runs if not inside[r[0]]), default=0):
            return "\n".join(lines[i][0] for r in marked for i in r)
    return "\n".join(lines[i][0] for r in _surges(weight, [False] * len(lines), size) for i in r)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars long): one row per row of ``pages``.

    A null, empty or blank page gives an empty text; a page that is cut off in
    the middle gives what stands before. Repeated rows and null keys give a
    row each, extra columns are not read. Each page is handled alone where it
    lies, whole: no shuffle."""
    def run(batches):
        for b in batches:
            got = [main_text(x or "") for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(got, pa.string()), pa.array(list(map(len, got)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return pages.select("page_id", "url", html).mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
