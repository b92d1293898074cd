"""Text expressions: trimming, titles, tokens, citations, URLs.  All are built-in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..conf import BOILERPLATE, DEFAULT, SMALL_WORDS, EngineConf

# What counts as a numbered title, a heading, a list item, and a line of a contents list.
NUMBERED = r"^(\d+)\\?\.\s+(.+)\z"
HEADING = r"^(#{1,6})\s+(.+)\z"
LIST_ITEM = r"^\s*([-*+]|\d+[.)])\s"
TOC_LINE = r"^\s*[-*]\s+\[([^\]]+)\]\(([^)]+)\)\s*\z"


#: White space of any kind: also the no-break space and the byte order mark.
BLANKS = " \t\n\x0b\f\r\u00a0\ufeff"


def trimmed(c: Column) -> Column:
    """Cut white space of any kind from both ends; blanks inside cost nothing."""
    return F.btrim(c, F.lit(BLANKS))


#: Letters whose capital is one letter by the simple mapping and several by the full one.
_SMALL = "ß" + "".join(chr(x) for a in (0x1F80, 0x1F90, 0x1FA0) for x in range(a, a + 8)) + "ᾳῃῳ"
_LARGE = "ẞ" + "".join(chr(x) for a in (0x1F88, 0x1F98, 0x1FA8) for x in range(a, a + 8)) + "ᾼῌῼ"


def simple_upper(c: Column) -> Column:
    """Upper case by Unicode's simple mapping, one letter for one; `upper` makes SS of a sharp s."""
    one = lambda x: F.when(F.length(F.upper(x)) == 1, F.upper(x)).otherwise(F.translate(x, _SMALL, _LARGE))
    return F.array_join(F.transform(F.split(c, ""), one), "")


def token_count(c: Column) -> Column:
    """Estimated tokens: a quarter of the characters, rounded up."""
    return F.ceil(F.length(c) / 4).cast("int")


def normalize_title(c: Column) -> Column:
    """Key of a title: lower case, marks dropped, everything but a-z and 0-9 one space."""
    c = F.regexp_replace(F.lower(c), r"[*_`]", "")
    return F.trim(F.regexp_replace(c, r"[^a-z0-9]+", " "))


def anchor_of(url: Column) -> Column:
    """What follows the first #, null without one."""
    at = F.locate("#", url)
    return F.when(at > 0, F.substr(url, at + 1))


def word_list(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def is_numbered(c: Column) -> Column:
    return trimmed(c).rlike(NUMBERED)


def is_question(p: Column, conf: EngineConf = DEFAULT) -> Column:
    return p.endswith("?") & (F.length(p) <= conf.max_question_chars) & ~p.contains("\n") & ~p.rlike(LIST_ITEM)


def is_table(p: Column) -> Column:
    rows = F.size(F.filter(F.split(p, "\n"), lambda x: trimmed(x).startswith("|")))
    return p.rlike(r"(?m)^\|") & (rows >= 2)


def is_title_case(t: Column, conf: EngineConf = DEFAULT) -> Column:
    words = word_list(t)
    telling = F.filter(words, lambda w: ~F.lower(w).isin(*SMALL_WORDS))
    capital = F.size(F.filter(telling, lambda w: w.rlike("^[A-Z]")))
    return (F.size(words) <= conf.max_heading_words) & (F.size(telling) > 0) & (capital >= F.size(telling) * conf.heading_caps_ratio)


def is_sentence_case(t: Column, conf: EngineConf = DEFAULT) -> Column:
    few = F.size(word_list(t)) <= conf.max_sentence_heading_words
    return (F.length(t) <= conf.max_sentence_heading_chars) & few & t.rlike("^[A-Z]") & ~t.contains(",")


def passes_exclusions(t: Column, conf: EngineConf = DEFAULT) -> Column:
    """Shape rules for a trimmed line; those of style do not bind numbered titles."""
    letters = F.length(F.regexp_replace(t, "[^a-zA-Z]", ""))
    upper = F.length(F.regexp_replace(t, "[^A-Z]", ""))
    shape = (
        F.length(t).between(1, conf.max_heading_chars)
        & ~t.rlike(r"^#{1,6}\s") & ~t.rlike(r"^[|>]") & ~t.rlike(r"\]\(")
        & (letters >= conf.min_heading_letters) & (upper <= letters * conf.max_heading_upper_ratio)
    )
    style = ~t.rlike(LIST_ITEM) & ~t.rlike(r"[.:;!?]\z") & ~t.rlike(r"^\*\*.*\*\*\z") & ~t.rlike(r"^[^:]{1,40}:\s*\S")
    return shape & (t.rlike(NUMBERED) | style)


def looks_like_heading(line: Column, conf: EngineConf = DEFAULT) -> Column:
    return has_heading_shape(trimmed(line), conf)


def has_heading_shape(t: Column, conf: EngineConf = DEFAULT) -> Column:
    """The test for a line that is trimmed already; pass a stored column, it is read many times."""
    return passes_exclusions(t, conf) & (t.rlike(NUMBERED) | is_title_case(t, conf) | is_sentence_case(t, conf))


def heading_title(line: Column) -> Column:
    """Title of a promoted line: bold marks off, `1\\.` read as `1.`."""
    t = F.regexp_replace(trimmed(line), r"^\*\*|\*\*\z", "")
    return F.regexp_replace(t, r"^(\d+)\\\.(\s)", "$1.$2")


def is_boilerplate(line: Column) -> Column:
    return trimmed(line).rlike(rf"(?i)^(?:{'|'.join(BOILERPLATE)})\z")


def normalize_markdown(md: Column) -> Column:
    """Line ends, furniture lines, a repeated leading title, blank runs, first heading at level 1."""
    md = F.regexp_replace(md, r"\r\n?", "\n")
    md = F.array_join(F.filter(F.split(md, "\n"), lambda x: ~is_boilerplate(x)), "\n")
    # A leading title said twice.  It is looked for where a line with text, or nothing, stands before its blank lines.
    pair = r"(?m)(?:\A|\S[^\S\n]*\n)\s*##\s+(.+)\n+#\s+(.+)$"
    bare = lambda i: F.regexp_replace(F.lower(F.regexp_extract(md, pair, i)), "[^a-z0-9]", "")
    a, b = bare(1), bare(2)
    same = md.rlike(pair) & (a != "") & (b.contains(a) | a.contains(b))
    found = F.regexp_extract(md, r"(?m)(?:\A|\S[^\S\n]*\n)\s*##\s+.+\n+(?=#\s)", 0)
    before = F.regexp_extract(found, r"\A\S[^\S\n]*\n", 0)
    at = F.position(found, md)
    once = F.when(same & (at > 0), F.concat(F.substr(md, F.lit(1), at - 1), before, F.substr(md, at + F.length(found)))).otherwise(md)
    md = F.when(md.contains("##"), once).otherwise(md)  # in a branch, so that texts without one are not searched
    md = F.array_join(F.transform(F.split(md, "\n"), lambda x: F.rtrim(x, F.lit(" \t"))), "\n")
    md = trimmed(F.regexp_replace(md, r"\n{3,}", "\n\n"))
    return F.when(md.rlike(r"^#\s"), md).otherwise(F.regexp_replace(md, r"(?s)\A((?:|.*?\n))#{2,6}(\s+)(?=.*[^\n])", "$1#$2"))


def content_hash(md: Column) -> Column:
    return F.sha2(md, 256)


def slug_title(url: Column) -> Column:
    """Last path segment of a URL as words, each with a capital; null when there is none."""
    path = F.regexp_replace(F.split_part(url, F.lit("?"), F.lit(1)), r"/\z", "")
    slug = F.nullif(F.element_at(F.split(path, "/"), -1), F.lit(""))
    words = F.split(F.regexp_replace(slug, "[-_]+", " "), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")


def derive_title(md: Column, title: Column, url: Column, filename: Column, conf: EngineConf = DEFAULT) -> Column:
    """First level-1 heading, else the page title without the site's name, else the slug, else the file name."""
    h1 = F.nullif(trimmed(F.regexp_extract(md, r"(?m)^#\s+(.+)$", 1)), F.lit(""))
    page = F.nullif(trimmed(F.regexp_replace(title, rf"(?i){conf.site_suffix}", "")), F.lit(""))
    if conf.site_default_title:
        page = F.when(~page.rlike(rf"(?i)^(?:{conf.site_default_title})\z"), page)
    return F.coalesce(h1, page, slug_title(url), filename)


def html_title(html: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def safe_upload_name(name: Column) -> Column:
    base = F.element_at(F.split(name, r"[/\\]"), -1)
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(base, r"[^\w.\- ]+", "_"), 1, 120), F.lit("")), F.lit("upload"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)\z", 1))


CHAT_ID = r"[A-Za-z0-9_-]{1,64}"


def is_chat_id(c: Column) -> Column:
    return c.rlike(rf"^{CHAT_ID}\z")


def is_rate_limit(message: Column) -> Column:
    return message.rlike(r"(?i)429|rate.?limit|quota|resource.?exhausted|empty embedding")


def citation_url(url: Column, anchor: Column) -> Column:
    return F.when(url.isNotNull(), F.concat_ws("#", url, anchor))


def snippet(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def embedding_text(path: Column, text: Column) -> Column:
    return F.concat_ws("\n\n", F.array_join(path, " › "), text)


def breadcrumb(title: Column, path: Column) -> Column:
    return F.concat(F.array(title), F.array_remove(path, title))


def backoff_ms(attempt: Column) -> Column:
    """Delay before the next try, without jitter."""
    return F.least(F.lit(30_000), (F.lit(500) * F.pow(F.lit(2.0), attempt)).cast("int"))


def progress_percent(done: Column, total: Column) -> Column:
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(0)).otherwise(F.round(done * 100 / total).cast("int"))


def relative_day(then: Column, now: Column) -> Column:
    days = F.datediff(now, then)
    return (
        F.when(days <= 0, F.date_format(then, "HH:mm")).when(days == 1, "Yesterday")
        .when(days < 7, F.concat(days.cast("string"), F.lit(" days ago"))).otherwise(F.date_format(then, "yyyy-MM-dd"))
    )


# Fixed value: markers such as [1] or [2, 3].
CITATION = r"\[(\d{1,2}(?:\s*,\s*\d{1,2})*)\]"


def cited_numbers(answer: Column) -> Column:
    """All numbers in markers such as [1] or [2, 3], in order of appearance; [2004] is not one."""
    groups = F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1))
    return F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda n: F.trim(n).cast("int"))))


def clean_citations(answer: Column, valid: Column) -> Column:
    """Markers keep only numbers in `valid` (array<int>), as [a][b]; spaces they leave are tidied."""
    groups = F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1))
    marks = F.transform(groups, lambda g: F.array_join(F.transform(
        F.filter(F.transform(F.split(g, ","), lambda n: F.trim(n).cast("int")), lambda n: F.array_contains(valid, n)),
        lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), ""))
    text = F.array_join(F.zip_with(F.split(answer, CITATION), marks, lambda a, m: F.concat(a, F.coalesce(m, F.lit("")))), "")
    return trimmed(F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}", " "), r" +([.,;:!?)\]])", "$1"))


def sse_frame(event: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.to_json(data), F.lit("\n\n"))


def chip_label(path: Column) -> Column:
    """Breadcrumb without the document's title; the title where there is nothing else."""
    return F.coalesce(F.nullif(F.array_join(F.slice(path, F.lit(2), F.greatest(F.size(path), F.lit(1))), " › "), F.lit("")), F.get(path, F.lit(0)))


def chunk_label(kind: Column, part_index: Column, part_count: Column, anchor: Column) -> Column:
    part = F.when(part_index.isNotNull(), F.concat(F.lit(" · part "), (part_index + 1).cast("string"), F.lit("/"), part_count.cast("string"))).otherwise("")
    return F.concat(kind, part, F.when(anchor.isNotNull(), F.concat(F.lit(" · #"), anchor)).otherwise(""))


def content_text(content: Column) -> Column:
    """Text of a message whose content is a list of parts: their texts, joined."""
    return F.array_join(F.transform(content, lambda p: F.coalesce(p["text"], F.lit(""))), "")


# Fixed value: how a line of a list begins.
BULLET = r"^\s*[*\-•]\s+"


def answer_blocks(answer: Column) -> Column:
    """array<struct<kind, items>>: an answer's blocks in order.

    A block whose lines are all bullets is a `list` of them; one that begins with other lines is
    `prose` of these, joined, and a `list` of the rest; any other is `prose` as it stands.
    """

    def of(block: Column) -> Column:
        lines = F.filter(F.transform(F.split(block, "\n"), trimmed), lambda x: x != "")
        bullets = F.transform(lines, lambda x: x.rlike(BULLET))
        first = F.array_position(bullets, True)
        items = lambda some: F.transform(some, lambda x: F.regexp_replace(x, BULLET, ""))
        made = lambda kind, some: F.named_struct(F.lit("kind"), F.lit(kind), F.lit("items"), some)
        split = F.array(made("prose", F.array(F.array_join(F.slice(lines, F.lit(1), F.greatest(first - 1, F.lit(0))), " "))), made("list", items(F.slice(lines, F.greatest(first, F.lit(1)), F.size(lines)))))
        none = F.filter(split, lambda b: F.lit(False))
        return F.when(F.size(lines) == 0, none).when(F.forall(bullets, lambda x: x), F.array(made("list", items(lines)))).when(first > 1, split).otherwise(F.array(made("prose", F.array(block))))

    return F.flatten(F.transform(F.split(answer, r"\n{2,}"), of))


def inline_tokens(text: Column) -> Column:
    """array<struct<bold, marker, text>>: pieces of a line in order; a marker [n] is its number, `**` marks are off."""

    def cut(whole: Column, pattern: str, inner: str) -> Column:
        """Pieces between the matches of a pattern, and the matches, by turns: struct<hit, text>."""
        piece = lambda hit, x: F.named_struct(F.lit("hit"), F.lit(hit), F.lit("text"), x)
        pairs = F.zip_with(F.split(whole, pattern), F.regexp_extract_all(whole, F.lit(inner), F.lit(1)), lambda a, b: F.array(piece(False, F.coalesce(a, F.lit(""))), piece(True, F.coalesce(b, F.lit("")))))
        return F.filter(F.flatten(pairs), lambda x: x["text"] != "")

    def marked(segment: Column) -> Column:
        named = lambda m: F.named_struct(F.lit("bold"), segment["hit"], F.lit("marker"), F.when(m["hit"], m["text"].cast("int")), F.lit("text"), F.when(~m["hit"], m["text"]))
        return F.transform(cut(segment["text"], r"\[\d{1,2}\]", r"\[(\d{1,2})\]"), named)

    return F.flatten(F.transform(cut(text, r"\*\*[^*]+\*\*", r"\*\*([^*]+)\*\*"), marked))
