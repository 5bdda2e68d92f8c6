"""String and pattern expressions.

Patterns are written for Java's regex engine with ASCII word boundaries spelled
out, because Java counts CJK letters as word characters at ``\\b``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: patterns and texts that stored results depend on ----------
WS = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
SPACE_CODES = [9, 10, 11, 12, 13, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACES = "".join(map(chr, [*SPACE_CODES, 0xFEFF]))
# The layout reader's own notion of a blank adds separators and drops the byte-order mark.
LAYOUT_SPACES = "".join(map(chr, [*SPACE_CODES, *range(0x1C, 0x20), 0x85]))
NOT_WORD_AHEAD = r"(?![A-Za-z0-9_])"
NOT_WORD_BEHIND = r"(?<![A-Za-z0-9_])"

# The look-ahead lists the alternatives' first characters; it only saves time.
REACTION_HINT = (
    r"(?i)(?=[反催酯萃产→℃°>scrypa-])(反应|催化|酯化|萃取|scheme|reaction|yield|产率|catalyst|smiles|→|->|>>|℃|°c"
    r"|substrate|reagent|afford|product \d)"
)
INTERESTING_TYPES = ["image", "table", "chart", "equation"]
FIGURE_TYPES = ["image", "table", "chart", "figure"]

ENTRY = rf"(?i)(?<![A-Za-z0-9])(\d+{WS}*[a-z]){WS}+(\d{{1,3}}(?:\.\d+)?){WS}*%"
CONDITION_LINE = rf"(?i)(?:general conditions?|一般条件|反应条件)[:：]?{WS}*([^\n]{{8,}})"
CATALYST = (
    rf"{NOT_WORD_BEHIND}([A-Z][A-Za-z0-9()\[\]]{{1,24}})"
    rf"(?:(?<=[A-Za-z0-9_]){NOT_WORD_AHEAD}|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
)
TEMPERATURE = rf"(?i)(\d+(?:\.\d+)?){WS}*(?:°c|℃|c{NOT_WORD_AHEAD})"
HOURS = rf"(?i)(\d+(?:\.\d+)?){WS}*h{NOT_WORD_AHEAD}"

SMILES_TOKEN = r"([A-Za-z0-9@+\-\[\]\(\)=#$\\/%\.]+>>[A-Za-z0-9@+\-\[\]\(\)=#$\\/%\.]+)"
LATEX_SPAN = r"\$\$([\s\S]+?)\$\$|\\mathrm\{[\s\S]+?\}"
LATEX_ARROW = r"rightarrow|\\\\to |→|->"
CONVERSION_TEXT = r"(?i)(>>|→|->|生成.{2,40}|转化为|afford|gave |obtained)"
MAPPED_ATOM = r":\d+"
PERCENT_NUMBER = rf"([0-9.]+){WS}*%"

# Something other than dots and white space.
REACTION_PART = rf"[^.{WS[1:]}"

TABLE_TAG = r"(?i)<table[\s>]"
TABLE_CAPTION = rf"(?i)表{WS}*\d+|table{WS}+\d+"

LABEL_PATTERNS = [
    ("molecule", r"(?i)mol|smiles|compound|化合物", []),
    ("reaction", r"(?i)反应|reaction|scheme|yield|产率|>>|→", ["image", "table", "equation"]),
    ("table", None, ["table"]),
    ("figure", None, ["image", "chart"]),
    ("formula", None, ["equation", "equation_interline"]),
]

ENTRY_SENTENCE = (
    "Substrate entry %s is converted to the corresponding product under the scheme conditions reported on page %d."
)
PAGE_HEADING = "## 第 %d 页"
CHUNK_COMMENT = "<!-- mineru-chunk %s pages %d-%d -->"
RXN_SEPARATOR = "\n\n$$$$\n\n"
# ------------------------------------------------------------------------------


def clean(c: Column) -> Column:
    """Collapse every run of Unicode whitespace to one space and trim."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    """Trim Unicode whitespace from both ends."""
    return F.btrim(c, F.lit(SPACES))


def truthy(c: Column) -> Column:
    """The string when it is non-empty, else null."""
    return F.nullif(c, F.lit(""))


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, null when nothing (or nothing but '') matches."""
    return truthy(F.regexp_extract(c, pattern, group))


def number_text(x: Column) -> Column:
    """Shortest decimal form of a double: 85.0 prints as 85, 85.5 as 85.5."""
    whole = (x == F.floor(x)) & (F.abs(x) < F.lit(1e15))
    plain = F.regexp_replace(x.cast("string"), r"\.0$", "")
    kind = F.when(F.abs(x) < 1, x.try_cast("decimal(38,36)").cast("string")).otherwise(x.try_cast("decimal(38,12)").cast("string"))
    wide = F.coalesce(F.regexp_replace(kind, r"\.?0+$", ""), x.cast("string"))
    return (
        F.when(whole, x.cast("bigint").cast("string"))
        .when((F.abs(x) < F.lit(1e-3)) | (F.abs(x) >= F.lit(1e7)), wide)
        .otherwise(plain)
    )


NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_number(s: Column) -> Column:
    """Number written in a string, else null."""
    return F.when(s.rlike(NUMERIC_TEXT), F.trim(s).try_cast("double"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def like_ascii(c: Column, query: str) -> Column:
    """Substring LIKE that folds ASCII case only; % and _ in the query stay wildcards."""
    pattern = "%" + "".join(ch.lower() if ch.isascii() else ch for ch in query) + "%"
    return ascii_lower(c).like(pattern.replace("\\", "\\\\"))


def interesting(text: Column, block_type: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(REACTION_HINT) | block_type.isin(*INTERESTING_TYPES)


def is_table_block(block_type: Column, text: Column, table_body: Column) -> Column:
    return (
        (block_type == "table")
        | F.coalesce(text, F.lit("")).rlike(TABLE_TAG)
        | F.coalesce(table_body, F.lit("")).rlike(TABLE_TAG)
    )


def table_html(text: Column, table_body: Column) -> Column:
    """The HTML to read a table from (the text test is case-sensitive)."""
    return F.when(F.contains(text, F.lit("<table")), text).otherwise(F.coalesce(table_body, F.lit("")))


def caption_line(text: Column) -> Column:
    """First line naming a numbered table."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(TABLE_CAPTION))
    return F.try_element_at(lines, F.lit(1))


def export_stem(filename: Column) -> Column:
    safe = F.regexp_replace(filename, r"[^A-Za-z0-9_.\u4e00-\u9fff-]+", "_")
    return F.regexp_replace(safe, r"(?i)\.pdf$", "")


def loose_json(text: Column) -> Column:
    """JSON object inside free text: a fenced block if any, from first { to last }."""
    fence = rf"(?i)```(?:json)?{WS}*([\s\S]*?)```"
    body = strip(text)
    body = F.when(body.rlike(fence), F.regexp_extract(body, fence, 1)).otherwise(body)
    first = F.instr(body, "{")
    last = F.length(body) - F.instr(F.reverse(body), "}") + 1
    found = (first > 0) & (F.instr(body, "}") > 0) & (last > first)
    return F.try_parse_json(F.when(found, F.substring(body, first, last - first + 1)).otherwise(body))


def is_reaction(smiles: Column) -> Column:
    """Does the text read as reactants>>products with something on both sides?"""
    left, right = F.substring_index(smiles, ">", 1), after(smiles, ">>")
    return F.contains(smiles, F.lit(">>")) & left.rlike(REACTION_PART) & right.rlike(REACTION_PART)


def after(c: Column, mark: str) -> Column:
    """What follows the first mark; the empty string where there is none."""
    at = F.instr(c, mark)
    return F.when(at > 0, F.substring(c, at + len(mark), F.length(c))).when(c.isNotNull(), F.lit(""))


def reaction_sides(smiles: Column) -> dict[str, Column]:
    """Text of each side: split at the first >>; agents follow a first > that stands alone."""
    rest = after(smiles, ">")
    agents = F.contains(rest, F.lit(">>")) & ~F.startswith(rest, F.lit(">"))
    return {
        "reactant": F.when(F.contains(smiles, F.lit(">")), F.substring_index(smiles, ">", 1)).when(smiles.isNotNull(), F.lit("")),
        "agent": F.when(agents, F.substring_index(rest, ">>", 1)).when(smiles.isNotNull(), F.lit("")),
        "product": after(smiles, ">>"),
    }


def reaction_side(side: Column) -> Column:
    """Non-empty dot-separated parts of one side of a reaction text."""
    return F.filter(F.transform(F.split(side, r"\."), strip), lambda x: x != "")


def reaction_syntax_error(smiles: Column) -> Column:
    """Error code, null when the text reads as reactants>>products."""
    blank = smiles.isNull() | ~smiles.rlike(rf"[^{WS[1:]}")
    return F.when(blank, F.lit("empty_reaction_smiles")).when(
        ~is_reaction(smiles), F.lit("reaction_smiles_must_use_reactants_>>_products")
    )


def percents(source: Column) -> Column:
    """Every number written before a percent sign, as it is written; negative ones with their sign.

    A number is negative where the sign follows neither digit nor point.
    """
    src = F.coalesce(source, F.lit(""))
    below = F.regexp_extract_all(src, F.lit(rf"(?<![0-9.])-{PERCENT_NUMBER}"), 1)
    runs = F.regexp_extract_all(src, F.lit(PERCENT_NUMBER), 1)
    # Most texts have no percent sign, and most others no minus sign.
    signed = F.concat(runs, F.transform(below, lambda x: F.concat(F.lit("-"), x)))
    found = F.when(F.contains(src, F.lit("-")), signed).otherwise(runs)
    return F.array_distinct(F.when(F.contains(src, F.lit("%")), found).otherwise(F.array().cast("array<string>")))


def among_percents(written: Column, number: Column) -> Column:
    """Is the number, printed, one of those that ``percents`` found?"""
    return F.array_contains(written, number_text(number))


def mentions_percent(source: Column, number: Column) -> Column:
    """Is the number written as ``N%`` in the source, not preceded by a digit or dot?"""
    return among_percents(percents(source), number)
