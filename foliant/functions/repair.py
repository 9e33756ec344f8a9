"""Repairs of LaTeX sources that failed to compile, as Column expressions.

A source is cut into segments, each of which begins with a line that includes an image; a segment whose image the log
misses is rewritten from its parts, and the segments are joined again. The other repairs are a table of conditions and
rewrites, of which the first that applies counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import _BEGIN, let, prepare_latex, strip

# What a log says of a missing image, what an include line looks like, and what replaces it.
_MISSING = r"(?i)File [`']([^`']+\.(?:pdf|png|jpg|jpeg|eps))[`'] not found"
_INCLUDE = r"(?s)^([^\S\n]*)\\includegraphics(?:\[([^\]\n]*)\])?\{([^}\n]+)\}[^\S\n]*(?:%[^\n]*)?(?:\n|$)(.*)$"
_DRAWING = (
    r"(?s)^(?:[^\S\n]*+(?:%(?!\s*\\begin\{tikzpicture\})[^\n]*+)?+\n)*+"
    r"([^\S\n]*%\s*\\begin\{tikzpicture\}[^\n]*\n(?:.*?\n)??[^\S\n]*%\s*\\end\{tikzpicture\}[^\n]*(?:\n|$))(.*)$"
)
_RESTORED, _GONE = "% Restored TikZ fallback for missing graphic: ", "% Missing source graphic: "
_BOX = (r"\fbox{\parbox[c][8em][c]{", r"}{\centering\footnotesize Source diagram unavailable}}")
_WIDTH = r"0.8\linewidth"
_EXPANSION, _MICROTYPE = r"\microtypesetup{expansion=false}", r"(?s)^(.*?)(\\usepackage\{[^}]*microtype[^}]*\})(.*)$"
_FONT, _KOTEX = r"\setmainfont{Malgun Gothic}", r"\usepackage{kotex}"


def missing_images(log: Column) -> Column:
    """The names of the images that a log misses."""
    return F.transform(F.regexp_extract_all(F.coalesce(log, F.lit("")), F.lit(_MISSING), F.lit(1)), strip)


def _file_name(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+$", ""), "([^/]*)$", 1)


def _segment(missing: Column):
    """A segment as a struct: its text after the repair, and whether it was repaired."""

    def repaired(x: Column) -> Column:
        indent, options, path, rest = (F.regexp_extract(x, _INCLUDE, i) for i in (1, 2, 3, 4))
        name = _file_name(strip(path))
        lost = x.rlike(_INCLUDE) & (F.array_contains(missing, strip(path)) | F.array_contains(missing, name))
        drawing = F.regexp_replace(F.regexp_extract(rest, _DRAWING, 1), r"(?m)^([^\S\n]*)%\s?", "$1")
        width = strip(F.regexp_extract(options, r"width\s*=\s*([^,\]]+)", 1))
        box = F.concat(indent, F.lit(_BOX[0]), F.when(width != "", width).otherwise(F.lit(_WIDTH)), F.lit(_BOX[1] + "\n"))
        restored = F.concat(indent, F.lit(_RESTORED), name, F.lit("\n"), drawing, F.regexp_extract(rest, _DRAWING, 2))
        boxed = F.concat(indent, F.lit(_GONE), name, F.lit("\n"), box, rest)
        new = F.when(rest.rlike(_DRAWING), restored).otherwise(boxed)
        return F.struct(F.when(lost, new).otherwise(x).alias("text"), lost.alias("lost"))

    return repaired


def repair_graphics(source: Column, log: Column) -> Column:
    """The source with drawings or boxes for the images that the log misses; null where there is nothing to repair.

    An image's drawing is a commented one that follows its line, past blank and comment lines only."""
    segments = F.split(source, r"(?m)^(?=[^\S\n]*\\includegraphics)")
    parts = let(missing_images(log), lambda m: F.transform(segments, _segment(m)))
    return let(parts, lambda p: F.when(F.exists(p, lambda x: x["lost"]), F.array_join(F.transform(p, lambda x: x["text"]), "")))


def _expansion_off(c: Column) -> Column:
    """Font expansion switched off behind the microtype package, else before the document; null where neither is."""
    part = [F.regexp_extract(c, _MICROTYPE, i) for i in (1, 2, 3)]
    at = F.locate(_BEGIN, c)
    before = F.concat(F.substring(c, F.lit(1), at - 1), F.lit(_EXPANSION + "\n"), F.substring(c, at, F.length(c)))
    return F.when(c.rlike(_MICROTYPE), F.concat(part[0], part[1], F.lit("\n" + _EXPANSION), part[2])).when(at > 0, before)


def _other_font(c: Column) -> Column:
    """The main font replaced by one that is there, or set behind kotex; null where neither is."""
    first = r"(?s)^(.*?)\\setmainfont\{[^}]+\}(.*)$"
    named = F.when(c.rlike(first), F.concat(F.regexp_extract(c, first, 1), F.lit(_FONT), F.regexp_extract(c, first, 2))).otherwise(c)
    return F.when(c.contains(r"\setmainfont{"), named).when(c.contains(_KOTEX), F.replace(c, F.lit(_KOTEX), F.lit(f"{_KOTEX}\n{_FONT}")))


def compile_fix(source: Column, log: Column, compiler: Column | str) -> Column:
    """The first repair that applies: graphics (prepared again), preparation, font expansion, dots in text, a missing font;
    else null."""
    kind, low = F.lit(compiler) if isinstance(compiler, str) else compiler, F.lower(F.coalesce(log, F.lit("")))

    def ladder(c: Column) -> Column:
        dots = F.regexp_replace(c, r"\\cdot(?!\s*\$)", r"\$\\cdot\$")
        rules = (
            (c != source, c),
            ((kind == "pdflatex") & low.contains("font expansion") & ~c.contains(_EXPANSION) & c.contains("microtype"), _expansion_off(c)),
            (low.contains("missing $ inserted") & (dots != c), dots),
            ((kind == "xelatex") & low.contains("fontspec") & low.contains("cannot be found"), _other_font(c)),
        )
        return F.coalesce(prepare_latex(repair_graphics(c, log), kind), *(F.when(applies, new) for applies, new in rules))

    return let(prepare_latex(source, kind), ladder)
