"""Text, path and name functions: Column in, Column out, without user functions but for the Unicode fold."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at both ends, of any script.
_ENDS = r"(?U)^\s+|\s+$"


def let(value: Column, body) -> Column:
    """body(value), the value computed once."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _ENDS, "")


def clean_text(c: Column) -> Column:
    """Stripped; null where nothing is left."""
    return F.nullif(strip(c.cast("string")), F.lit(""))


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def norm(c: Column) -> Column:
    """Lower case, stripped, empty for null."""
    return F.lower(strip(F.coalesce(c.cast("string"), F.lit(""))))


def coerce_year(c: Column) -> Column:
    """An integer of 1500 to 2100, or the first such year that stands in the text."""
    year = found(c.cast("string"), r"\b(1[5-9]\d{2}|20\d{2}|2100)\b").try_cast("int")
    whole = c.cast("string").rlike(r"^\s*[+-]?\d+\s*$")
    value = F.trim(c.cast("string")).try_cast("int")
    return F.when(whole & ~value.between(1500, 2100), F.lit(None)).otherwise(year)


def coerce_int(c: Column) -> Column:
    return F.when(c.cast("string").rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c.cast("string")).try_cast("int"))


def sort_name(c: Column) -> Column:
    """Lower case, runs of white space as one blank."""
    return F.nullif(F.lower(strip(F.regexp_replace(c, r"(?U)\s+", " "))), F.lit(""))


def century(year: Column) -> Column:
    return F.floor((year - 1) / 100).cast("int") + 1


def ordinal(n: Column) -> Column:
    suffix = F.when((n % 100).isin(11, 12, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def century_label(year: Column) -> Column:
    """"18th century"; null for no year or one before 1."""
    return F.when(year > 0, F.concat(ordinal(century(year)), F.lit(" century")))


def era_id(label: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(label), r"[^a-z0-9]+", "-"), r"^-|-$", "")
    return F.concat(F.lit("era-"), F.when(s == "", F.lit("undated")).otherwise(s))


def truncate(c: Column, most: int = 96) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, most - 3), r"(?U)\s+$", ""), F.lit("...")))


def slug_of_folded(folded: Column, original: Column) -> Column:
    """The slug of a title whose ASCII fold is given."""
    s = F.lower(strip(folded))
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[^\w\s-]", ""), r"[-\s]+", "-"), r"^-+|-+$", "")
    return F.when(strip(original) == "", F.lit("untitled-document")).when(s == "", F.concat(F.lit("document-"), F.substring(F.sha2(strip(original), 256), 1, 12))).otherwise(s)


# LaTeX

_BEGIN, _END = r"\begin{document}", r"\end{document}"


def is_latex(c: Column) -> Column:
    return F.coalesce(c.contains(r"\documentclass") | c.contains(_BEGIN), F.lit(False))


def latex_body(c: Column) -> Column:
    """What stands between the first begin and the first end of the document; all, without both."""
    pattern = r"(?s)\\begin\{document\}(.*?)\\end\{document\}"
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1)).otherwise(c)


#: Rewrites in their order: pattern, replacement. Fixed values.
_READABLE = (
    (r"(?m)^\s*%.*$", ""),
    (r"\\newpage", "\n\n"),
    (r"\\\\", "\n"),
    (r"\\(?:begin|end)\{[^}]+\}", "\n"),
    (r"\\(?:textit|textbf|textsc|emph|underline|mbox|textrm|textsf|texttt)\{([^{}]*)\}", "$1"),
    (r"\\(?:section|subsection|subsubsection)\*?\{([^{}]*)\}", "\n$1\n"),
    (r"\\(?:noindent|indent|centering|small|footnotesize|normalsize|large|Large|LARGE|huge|Huge|vspace\*?|hspace\*?)\b(?:\{[^}]*\})?", " "),
    (r"\\(?:fancyhead|fancyfoot|renewcommand|geometry|pagestyle|setmainfont|setmainhangulfont|setmainhanjafont)\b.*", " "),
    (r"\\[A-Za-z@]+(?:\[[^\]]*\])?(?:\{[^{}]*\})?", " "),
    (r"[{}]", " "),
    (r"\s+\n", "\n"),
    (r"\n{3,}", "\n\n"),
    (r"[ \t]{2,}", " "),
)


def latex_to_text(c: Column) -> Column:
    """Readable text of LaTeX."""
    c = latex_body(c)
    for pattern, to in _READABLE:
        c = F.regexp_replace(c, pattern, to)
    return strip(c)


def split_pages(c: Column) -> Column:
    """The pages of a document, each wrapped as a document of its own."""
    pattern = r"(?s)^(.*?\\begin\{document\})(.*)\\end\{document\}\s*$"

    def cut(x: Column) -> Column:
        chunks = F.filter(F.transform(F.split(F.regexp_extract(x, pattern, 2), r"\n\s*\\newpage\s*\n"), strip), lambda k: k != "")
        # The head is taken once, not in each page's turn: that would read the document as often as it has pages.
        wrapped = lambda ks: let(F.regexp_extract(x, pattern, 1), lambda head: F.transform(ks, lambda k: F.concat(head, F.lit("\n"), k, F.lit("\n" + _END))))
        return F.when(x.rlike(pattern), let(chunks, lambda ks: F.when(F.size(ks) > 0, wrapped(ks))))

    return let(c, lambda x: F.coalesce(cut(x), F.array(x)))


def merge_pages(pages: Column) -> Column:
    """One document of several: the first page's preamble, all bodies. An array of one is that page; of none, null."""
    begin = r"(?s)^.*?\\begin\{document\}"
    bodied = lambda p: F.when(p.contains(_BEGIN), strip(F.regexp_replace(F.regexp_replace(p, begin, ""), r"\\end\{document\}\s*$", ""))).otherwise(F.lit(""))
    head = lambda p: F.when(p.contains(_BEGIN), F.regexp_extract(p, begin, 0)).otherwise(p)
    joined = lambda ps: F.concat(head(ps[0]), F.lit("\n"), F.array_join(F.transform(ps, bodied), "\n\n\\newpage\n\n"), F.lit("\n" + _END))
    return let(pages, lambda ps: F.when(F.size(ps) == 1, ps[0]).when(F.size(ps) > 1, joined(ps)))


#: What surrounds a model's answer, in the order in which it is taken off. Fixed values.
_WRAPPERS = (r"^%%%\s*BEGIN_[A-Z_]+\s*%%%[\r\n]*", r"[\r\n]*%%%\s*END_[A-Z_]+\s*%%%$", r"(?i)^```(?:latex)?\s*", r"\s*```$")


def normalize_latex(c: Column) -> Column:
    """Stripped of marker lines and code fences at its ends, and closed where it was begun."""
    s = strip(c)
    for pattern in _WRAPPERS:
        s = F.regexp_replace(s, pattern, "")
    return let(s, lambda x: F.when(x.contains(_BEGIN) & ~x.contains(_END), F.concat(x, F.lit(f"\n\n{_END}\n"))).otherwise(x))


def extract_block(c: Column, tag: str) -> Column:
    """The text between a tag and its end (or the text's), else that of a fenced block, else null."""
    end = "END_" + tag.removeprefix("BEGIN_")
    ladder = (rf"(?s)%%%\s*{tag}\s*%%%(.*?)%%%\s*{end}\s*%%%", rf"(?s)%%%\s*{tag}\s*%%%(.*)$", r"(?is)```(?:latex)?\s*(.*?)```")
    return F.coalesce(*(F.when(c.rlike(p), strip(F.regexp_extract(c, p, 1))) for p in ladder))


def plausible_fix(old: Column, new: Column) -> Column:
    """Whether a repaired source keeps nine tenths of the length."""
    o, n = F.length(strip(F.coalesce(old, F.lit("")))), F.length(strip(F.coalesce(new, F.lit(""))))
    return (o > 0) & (n >= F.floor(o * 0.9))


def _before_document(c: Column, snippet: Column) -> Column:
    """Puts a line before the document's begin, unless the source has it."""
    at = F.locate(_BEGIN, c)
    put = F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), snippet, F.lit("\n"), F.substring(c, at, F.length(c)))).otherwise(F.concat(F.regexp_replace(c, r"\s+$", ""), F.lit("\n"), snippet, F.lit("\n")))
    return F.when(F.contains(c, snippet), c).otherwise(put)


#: Signs of footnotes, and their numbers. Fixed values.
_FOOTNOTE_SIGNS = (("*", "1"), ("†", "2"), ("‡", "3"), ("§", "4"), ("\\dagger", "2"), ("\\ddagger", "3"), ("\\S", "4"))
#: What calls for a package. Fixed values.
_NEEDS = (
    (r"\\(?:includegraphics|scalebox|resizebox|rotatebox|reflectbox)\b", "graphicx"),
    (r"\\begin\{(?:wrapfigure|wraptable)\}", "wrapfig"),
    (r"\\begin\{tikzpicture\}", "tikz"),
    (
        r"\\(?:begin\{(?:align\*?|gather\*?|multline\*?|cases|split|aligned|gathered)\}"
        r"|(?:text|dfrac|tfrac|eqref|tag|substack|overset|underset|xrightarrow|xleftarrow|operatorname|boxed)\b)",
        "amsmath",
    ),
    (r"\\(?:mathbb|mathfrak|therefore|because|square|blacksquare|triangleq|lesssim|gtrsim|leqslant|geqslant|varnothing)\b", "amssymb"),
    (r"\\mathscr", "mathrsfs"),
)
#: What calls for lines before the document, what says that they are there, and the lines. Fixed values.
_DEFINITIONS = (
    (r"\\longequal", r"\\(?:providecommand|newcommand)\{\\longequal\}", (r"\providecommand{\longequal}{=}",)),
    (
        r"\\(?:coloneqq|eqqcolon|Coloneqq|Eqqcolon)",
        r"\\(?:providecommand|newcommand)\{\\coloneqq\}",
        (r"\providecommand{\coloneqq}{\mathrel{:=}}", r"\providecommand{\eqqcolon}{\mathrel{=:}}", r"\providecommand{\Coloneqq}{\mathrel{::=}}", r"\providecommand{\Eqqcolon}{\mathrel{=::}}"),
    ),
)
#: Lines that a long s needs under pdfLaTeX; the last is unknown to XeLaTeX. Fixed values.
_LONG_S = (r"\usepackage{textcomp}", r"\DeclareTextSymbol{\textlongs}{TS1}{116}", r"\DeclareTextSymbolDefault{\textlongs}{TS1}", r"\DeclareUnicodeCharacter{017F}{\textlongs}")
_ONLY_PDFLATEX = r"(?m)^[ \t]*\\DeclareUnicodeCharacter\{017F\}\{\\textlongs\}\s*\n?"


def prepare_latex(c: Column, compiler: Column | str = "pdflatex") -> Column:
    """A source ready for a compiler: normalized, numbered footnotes, decimal dots in math mode, packages and definitions
    for what it uses, and for a long s what pdfLaTeX needs and other compilers don't know."""
    kind = F.lit(compiler) if isinstance(compiler, str) else compiler
    c = normalize_latex(c)
    for sign, number in _FOOTNOTE_SIGNS:
        c = F.regexp_replace(c, rf"\\(footnote|footnotemark|footnotetext)\s*\[{re.escape(sign)}\]", rf"\\$1[{number}]")
    c = F.regexp_replace(c, r"(?<!\$)(\d)\\cdot(?=\d)", r"$1\$\\cdot\$")
    return let(c, _prepared(kind))


def _prepared(kind: Column):
    """What the source needs before its document, all told from the source as it is, is put there at once."""

    def body(c: Column) -> Column:
        loaded = lambda name: c.rlike(rf"\\usepackage(?:\[[^\]]*\])?\{{[^}}]*\b{name}\b[^}}]*\}}")
        wanted = [(c.rlike(used) & ~loaded(name), f"\\usepackage{{{name}}}") for used, name in _NEEDS]
        wanted += [(c.rlike(used) & ~c.rlike(there), line) for used, there, lines in _DEFINITIONS for line in lines]
        wanted += [((kind == "pdflatex") & c.contains("ſ"), line) for line in _LONG_S]
        lines = F.filter(F.array(*(F.when(need & ~c.contains(line), F.lit(line)) for need, line in wanted)), lambda x: x.isNotNull())
        put = let(F.array_join(lines, "\n"), lambda x: F.when(x == "", c).otherwise(_before_document(c, x)))
        return F.when(kind != "pdflatex", F.regexp_replace(put, _ONLY_PDFLATEX, "")).otherwise(put)

    return body


def apply_layout(c: Column, font_pt: Column, geometry: Column, note: Column) -> Column:
    """The class's font size and the page geometry set from a layout profile, and a comment that says so."""
    c = let(c, lambda x: _sized(x, font_pt))
    set_, old = F.concat(F.lit("\\geometry{"), geometry, F.lit("}")), r"(?s)^(.*?)\\geometry\{[^}]*\}(.*)$"
    loaded = lambda x: F.when(x.rlike(old) | x.contains("\\usepackage{geometry}"), x).otherwise(_before_document(x, F.lit("\\usepackage{geometry}")))
    placed = lambda x: F.when(x.rlike(old), F.concat(F.regexp_extract(x, old, 1), set_, F.regexp_extract(x, old, 2))).otherwise(_before_document(x, set_))
    return let(let(let(c, loaded), placed), lambda x: _before_document(x, F.concat(F.lit("% Auto layout profile: "), note)))


def _sized(c: Column, font_pt: Column) -> Column:
    """The class with a font size for its first option."""
    klass = r"(?s)^(.*?)\\documentclass(?:\[([^\]]*)\])?\{([^}]+)\}(.*)$"
    part = lambda i: F.regexp_extract(c, klass, i)
    options = F.filter(F.transform(F.split(part(2), ","), strip), lambda o: (o != "") & ~o.rlike(r"^\d+pt$"))
    options = F.array_join(F.concat(F.array(F.concat(font_pt.cast("string"), F.lit("pt"))), options), ",")
    return F.when(c.rlike(klass), F.concat(part(1), F.lit("\\documentclass["), options, F.lit("]{"), part(3), F.lit("}"), part(4))).otherwise(c)


def tex_length(x: Column, unit: str) -> Column:
    s = F.format_string("%.2f", F.bround(x.cast("double"), 2))
    return F.concat(F.regexp_replace(F.regexp_replace(s, r"0+$", ""), r"\.$", ""), F.lit(unit))


def log_message(line: Column) -> Column:
    """What kind of warning a compiler's log line is; null for none."""
    s = strip(line)
    cut = lambda c: strip(F.regexp_replace(c, r"\s+on input line \d+\.?$", ""))
    warn, latex, info = r"^Package (\S+) Warning:\s*(.+)$", r"^LaTeX Warning:\s*(.+)$", r"^Package (\S+) Info:\s*(.+ is missing)\s*$"
    return (
        F.when(s.startswith(r"Overfull \hbox"), "Overfull hbox").when(s.startswith(r"Underfull \hbox"), "Underfull hbox").when(s.startswith("Missing character:"), "Missing character")
        .when(s.rlike(warn), F.concat(F.regexp_extract(s, warn, 1), F.lit(" warning: "), cut(F.regexp_extract(s, warn, 2))))
        .when(s.rlike(latex), F.concat(F.lit("LaTeX warning: "), cut(F.regexp_extract(s, latex, 1))))
        .when(s.rlike(info), F.concat(F.regexp_extract(s, info, 1), F.lit(" info: "), F.regexp_extract(s, info, 2)))
    )


# Paths and pages

#: Suffix after the document's name -> (asset type, canonical name). Fixed values.
NAMED_ASSETS = {
    "_source.pdf": ("source_pdf", "source.pdf"),
    "_digitalized.pdf": ("digitalized_pdf", "digitalized.pdf"),
    "_korean.pdf": ("korean_pdf", "korean.pdf"),
    "_digitalized.tex": ("digitalized_tex", "digitalized.tex"),
    "_korean.tex": ("korean_tex", "korean.tex"),
    "_merged.tex": ("merged_tex", "merged.tex"),
    "_metadata.json": ("metadata", "metadata.json"),
    "_quality_report.json": ("quality_report", "quality_report.json"),
    "_rights_check.json": ("rights_check", "rights_check.json"),
    "_pipeline_state.json": ("pipeline_state", "pipeline_state.json"),
    "_layout_profile.json": ("layout_profile", "layout_profile.json"),
    "_transcription_notes.txt": ("transcription_notes", "transcription_notes.txt"),
    "_translation_notes.txt": ("translation_notes", "translation_notes.txt"),
}
#: Page files -> asset type. Fixed values.
PAGE_ASSETS = ((r"^page_\d{3}\.tex$", "page_tex"), (r"^page_\d{3}_structure\.json$", "page_structure"), (r"^page_\d{3}_failure\.json$", "page_failure"))
#: Extension -> MIME type of what is published. Fixed values.
MIME = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "json": "application/json", "tex": "text/x-tex", "txt": "text/plain"}


def asset_type(path: Column, name: Column, long: bool = False) -> Column:
    """The kind of a file. Files of pages have three digits in their names; with long, three or more, for documents of over 999 pages."""
    rel = F.replace(path, F.lit("\\"), F.lit("/"))
    out = F.lit("artifact")
    for pattern, kind in reversed(PAGE_ASSETS):
        out = F.when(rel.rlike(pattern.replace("{3}", "{3,}") if long else pattern), kind).otherwise(out)
    out = F.when(rel.startswith("images/"), "page_image").otherwise(out)
    for suffix, (kind, _) in reversed(NAMED_ASSETS.items()):
        out = F.when(F.lower(rel) == F.concat(F.lower(name), F.lit(suffix)), kind).otherwise(out)
    return out


def _storage_part(part: Column, folded: Column) -> Column:
    """A path segment made safe; folded is its ASCII fold."""
    suffix = r"(?<=.)((?:\.[^.\s/]+)+)$"
    tail = F.lower(F.regexp_extract(part, suffix, 1))
    stem = F.regexp_replace(folded, suffix, "")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(strip(stem)), r"[^\w\s-]", ""), r"[-\s]+", "-"), r"^-+|-+$", "")
    return F.when(part.isin(".", ".."), F.lit("part")).otherwise(F.concat(F.when(s == "", F.concat(F.lit("file-"), F.substring(F.sha2(part, 256), 1, 12))).otherwise(s), tail))


def storage_path(path: Column, kind: Column, folded: Column) -> Column:
    """Where an asset is stored; folded is the path's ASCII fold."""
    rel = F.replace(path, F.lit("\\"), F.lit("/"))
    base = F.element_at(F.split(rel, "/"), -1)
    parts = F.zip_with(F.filter(F.split(rel, "/"), lambda p: p != ""), F.filter(F.split(F.replace(folded, F.lit("\\"), F.lit("/")), "/"), lambda p: p != ""), _storage_part)
    out = F.array_join(parts, "/")
    out = F.when((kind == "page_image") & rel.rlike(r"^images/page_\d{3}\.(png|jpg|jpeg)$"), rel).otherwise(out)
    for pattern, k in PAGE_ASSETS:
        out = F.when((kind == k) & base.rlike(pattern), base).otherwise(out)
    for k, canonical in NAMED_ASSETS.values():
        out = F.when(kind == k, canonical).otherwise(out)
    return out


def mime_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))
    out = F.lit("application/octet-stream")
    for e, m in MIME.items():
        out = F.when(ext == e, m).otherwise(out)
    return out


def public_url(base: str, bucket: Column, path: Column) -> Column:
    """The public address of a stored object; null without path or base."""

    def enc(c: Column) -> Column:
        out = F.url_encode(c)
        for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    root = base.removesuffix("/")
    full = F.concat(F.lit(f"{root}/storage/v1/object/public/"), enc(bucket), F.lit("/"), F.array_join(F.transform(F.split(path, "/"), enc), "/"))
    return F.when((path != "") & F.lit(bool(base)), full)


def page_name(n: Column, ext: str = "tex") -> Column:
    return F.format_string(f"page_%03d.{ext}", n)


def parse_page_range(spec: Column, n: Column) -> Column:
    """Places from 0 of a range such as 1-3,5, in order, those out of range left out. Malformed parts fail."""
    ints = lambda a: F.trim(a).cast("int")
    one = F.transform(F.filter(F.split(spec, ","), lambda p: F.trim(p) != ""), lambda p: F.when(
        p.contains("-"), F.when(ints(F.split_part(p, F.lit("-"), F.lit(1))) <= ints(F.split_part(p, F.lit("-"), F.lit(2))),
            F.sequence(ints(F.split_part(p, F.lit("-"), F.lit(1))), ints(F.split_part(p, F.lit("-"), F.lit(2))))).otherwise(F.array().cast("array<int>"))).otherwise(F.array(ints(p))))
    return F.transform(F.filter(F.flatten(one), lambda i: (i >= 1) & (i <= n)), lambda i: i - 1)


def coerce_pages(values: Column, ordered: bool = True) -> Column:
    """Distinct positive page numbers of an array of strings, sorted or as first seen."""
    ints = F.array_distinct(F.filter(F.transform(values, coerce_int), lambda i: i.isNotNull() & (i > 0)))
    return F.coalesce(F.array_sort(ints) if ordered else ints, F.array().cast("array<int>"))


def sample_evenly(values: Column, k: int) -> Column:
    """At most k values, evenly spread, ends included."""
    last = F.size(values) - 1
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * last / max(k - 1, 1)).cast("int")))
    return F.when(F.size(values) <= k, values).otherwise(F.transform(at, lambda i: F.get(values, i)))


def page_snippet(original: Column, korean: Column, empty: str = "No extracted text available.") -> Column:
    """The first 140 characters of a page's text, the original's if there is one."""
    s = strip(F.regexp_replace(F.coalesce(original, korean, F.lit("")), r"(?U)\s+", " "))
    return let(s, lambda x: F.when(x == "", empty).when(F.length(x) > 140, F.concat(F.rtrim(F.substring(x, 1, 137)), F.lit("..."))).otherwise(x))


def page_availability(original: Column, korean: Column) -> Column:
    a, b = clean_text(original).isNotNull(), clean_text(korean).isNotNull()
    return F.when(a & b, "Original + Korean").when(a, "Original only").when(b, "Korean only").otherwise("Image only")


def output_name(files: Column, suffixes: Sequence[str]) -> Column:
    """The one name that files with the suffixes share, as (name, error)."""
    pattern = r"^(.+)(?:" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"
    names = F.array_sort(F.array_distinct(F.filter(F.transform(files, lambda f: F.nullif(F.regexp_extract(f, pattern, 1), F.lit(""))), lambda x: x.isNotNull())))
    return F.struct(F.when(F.size(names) == 1, names[0]).alias("name"), F.when(F.size(names) == 0, "not found").when(F.size(names) > 1, "ambiguous").alias("error"))


#: Extension -> media type of an image that goes to a model; anything else counts as PNG. Fixed values.
IMAGES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg"}


def media_type(path: Column) -> Column:
    ext, out = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)), F.lit("image/png")
    for e, m in IMAGES.items():
        out = F.when(ext == e, m).otherwise(out)
    return out


def image_part(path: Column, content: Column) -> Column:
    """An image as a model takes it: media type and base64."""
    return F.struct(media_type(path).alias("media_type"), F.base64(content).alias("data"))


def normal_path(path: Column, base: str) -> Column:
    """An absolute path without . and .. segments; a relative one is below base. Null for an empty one."""
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))
    steps = F.filter(F.split(whole, "/"), lambda p: ~p.isin("", "."))
    up = lambda s, p: F.when(p == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(p)))
    return F.when(F.coalesce(path, F.lit("")) != "", F.concat(F.lit("/"), F.array_join(F.aggregate(steps, F.array().cast("array<string>"), up), "/")))


#: Characters of a page's structure or source that a model is shown. Fixed value.
SHOWN = 12_000


def shown(c: Column) -> Column:
    """What a model is shown of a text."""
    return F.substring(c, 1, SHOWN)
