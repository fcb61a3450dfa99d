"""Text columns: removal of LaTeX markup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Environments that go with their content, and markup patterns with what stays of them, in this order.
# The environments go before the rules of ``LAST``.
DOCUMENT = (r"\begin{document}", r"\end{document}")
ENVIRONMENTS = ("table", "tabular", "thebibliography")
LATEX_RULES = (
    (r"\\(section|subsection|subsubsection)\*?\{([^}]+)\}", "$2"),
    (r"\\(textbf|textit|emph|texttt)\{([^}]+)\}", "$2"),
    (r"\\(citep|citet|ref)\{[^}]+\}", ""),
    (r"~\\ref\{[^}]+\}", ""),
    (r"\\label\{[^}]+\}", ""),
    (r"\\begin\{equation\}[^\\]*\\end\{equation\}", ""),
    (r"\\begin\{(itemize|enumerate|description)\}", ""),
    (r"\\end\{(itemize|enumerate|description)\}", ""),
    (r"\\item\s*\\(textbf)?\{([^}]+)\}", "- $2"),
    (r"\\item\s+", "- "),
)
LAST = (
    (r"\\bibitem\{[^}]+\}", ""),
    (r"\\newblock", ""),
    (r"\\(maketitle|tableofcontents|newpage|centering|caption\{[^}]+\})", ""),
    (r"\\[a-zA-Z]+\{[^}]*\}", ""),
    (r"\\([a-zA-Z]+)", ""),
    (r"\n{3,}", "\n\n"),
    (r" +", " "),
)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once however often the body names it; a plain reuse computes it at each place."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(text: Column, name: str) -> Column:
    """``text`` without each stretch from a begin mark to the next end mark. Cut at the end marks, a piece loses what
    stands behind its first begin mark; behind the last end mark nothing goes. Linear, however many marks stay open."""
    begin, end = f"\\begin{{{name}}}", f"\\end{{{name}}}"

    def joined(pieces: Column) -> Column:
        closed = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.when(F.contains(p, F.lit(begin)), F.substring_index(p, begin, 1)).otherwise(F.concat(p, F.lit(end))))
        return F.concat(F.array_join(closed, ""), F.element_at(pieces, -1))

    return _once(text, lambda t: F.when(F.contains(t, F.lit(begin)), _once(F.split(t, "\\Q" + end + "\\E", -1), joined)).otherwise(t))


def strip_latex(text: Column) -> Column:
    """TXT-1: prose without commands; lines trimmed, empty lines dropped. Only what follows the last beginning of a
    document counts, up to the first end."""
    begin, end = DOCUMENT
    out = F.substring_index(F.substring_index(text, begin, -1), end, 1)
    for pattern, keep in LATEX_RULES:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(keep))
    for name in ENVIRONMENTS:
        out = _without(out, name)
    for pattern, keep in LAST:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(keep))
    lines = F.transform(F.split(out, "\n"), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")
