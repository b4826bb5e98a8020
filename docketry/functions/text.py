"""Text functions: HTML to text, entities, normal forms for containment, tokens, block ids, segmentation.

All are column expressions but for NFKC, numeric entities and the longest common subsequence, which run in Arrow
batches on the rows that need them.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.functions.trees import let, record

# The named entities that are decoded. Others stay as written.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ensp": " ", "emsp": " ", "thinsp": " ",
    "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "deg": "°",
    "frac12": "½", "frac14": "¼", "frac34": "¾", "auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö",
    "Uuml": "Ü", "szlig": "ß", "eacute": "é", "egrave": "è", "ecirc": "ê", "agrave": "à", "acirc": "â", "ccedil": "ç",
    "ugrave": "ù", "icirc": "î", "iuml": "ï", "ocirc": "ô",
}
# Elements that break a line.
BLOCKS = "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
# Dashes and quotes that count as one.
DASHES, SINGLE, DOUBLE = "‐‑‒–—−", "‘’‚", "“”„"

# What counts as white space.
SPACES = "\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

#: A tag: quoted spans whole, so that a ">" in an attribute does not end it; up to the first ">" where a quote is left
#: open. The group is possessive, so the matcher keeps no state for each attribute.
_QUOTED = r"""(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+>"""
_PLAIN = "[^>]*+>"


#: The same, character by character.
_EACH_SPACE = "".join(c for c in map(chr, range(0x10000)) if re.match(f"[{SPACES}]", c))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.trim(text, F.lit(_EACH_SPACE))


def _named(text: Column) -> Column:
    """Named entities, each once: what one gives is never read as another's start, so the ampersand comes last."""
    order = [n for n in ENTITIES if n != "amp"] + ["amp"]
    return reduce(lambda t, n: F.replace(t, F.lit(f"&{n};"), F.lit(ENTITIES[n])), order, text)


@F.pandas_udf(T.StringType())
def _numeric(texts: pd.Series) -> pd.Series:
    def one(match: re.Match) -> str:
        digits, base = (match[2], 10) if match[2] else (match[1], 16)
        code = int(digits[-12:], base) if not digits[:-12].strip("0") else 1 << 40
        return chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else match[0]

    return texts.map(lambda t: None if t is None else re.sub(r"&#(?:x([0-9a-fA-F]+)|([0-9]+));", one, t))


def decoded(text: Column, numeric: bool = True) -> Column:
    """Entities decoded: numeric ones first, then the named ones that are known."""
    if numeric:
        text = F.when(F.contains(text, F.lit("&#")), _numeric(text)).otherwise(text)
    return _named(text)


def html_to_text(html: Column, numeric: bool = True) -> Column:
    """Lines of text. The order of steps matters: scripts and comments go before tags, block tags before others."""
    t = html
    for region in ("script", "style", "head"):
        t = F.regexp_replace(t, rf"(?is)<{region}\b.*?</{region}\s*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    block = rf"</?(?:{'|'.join(BLOCKS)})\b"
    t = F.regexp_replace(t, rf"(?i)(?:{block}{_QUOTED}|{block}{_PLAIN})", "\n")
    t = decoded(F.regexp_replace(t, rf"(?:<{_QUOTED}|<{_PLAIN})", ""), numeric)
    t = F.regexp_replace(t, f"[{SPACES}&&[^\n]]+", " ")
    return F.array_join(F.filter(F.transform(F.split(t, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normal(text: Column, compatibility: bool = True) -> Column:
    """The form in which containment is tested: NFKC, one dash, one quote, hyphenation joined, spaces, case.

    Texts of ASCII alone are their own NFKC form, so the function's result is only taken for the others.
    """
    if compatibility:
        text = F.when(F.length(text) == F.octet_length(text), text).otherwise(nfkc(text))
    signs = DASHES + SINGLE + DOUBLE + "\u00a0"
    plain = "-" * len(DASHES) + "'" * len(SINGLE) + '"' * len(DOUBLE) + " "
    # one cheap look finds the texts, a few, that may hold signs or white space beyond ASCII; single spaces stay as they are
    rejoined = lambda t: F.when(F.contains(t, F.lit("-")), F.regexp_replace(t, r"(\p{L})-\s*(\p{L})", "$1$2")).otherwise(t)
    rare = lambda t: F.regexp_replace(let(F.translate(t, signs, plain), rejoined), r"(?U)\s+", " ")
    usual = lambda t: F.regexp_replace(let(t, rejoined), r"[\t-\r][\t-\r ]*+| [\t-\r ]++", " ")
    spaced = let(text, lambda t: F.when(F.regexp_like(t, F.lit("[\u0085\u00a0\u1680\u2000-\u3000]")), rare(t)).otherwise(usual(t)))
    return F.lower(F.trim(spaced))


def words(normal_text: Column) -> Column:
    return F.regexp_extract_all(normal_text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, with a row of the table as the bits of one integer."""
    places: dict[str, int] = {}
    for k, word in enumerate(b):
        places[word] = places.get(word, 0) | 1 << k
    full = (1 << len(b)) - 1
    row = full
    for word in a:
        hit = row & places.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def common_words(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_subsequence(list(x), list(y)) for x, y in zip(a, b)])


def coverage(pairs: DataFrame, claim: str, evidence: str) -> DataFrame:
    """pairs with coverage: 1 where the claim is empty or contained, else the share of its words in common order.

    The subsequence is computed for the failures alone, as a frame of its own.
    """
    inside = F.contains(evidence, F.col(claim)) | (F.col(claim) == "")
    passed = pairs.where(inside).withColumn("coverage", F.lit(1.0))
    own = words(F.col(claim))
    share = F.when(F.size(own) == 0, F.lit(1.0)).otherwise(common_words(own, words(F.col(evidence))) / F.size(own))
    return passed.union(pairs.where(~inside).withColumn("coverage", share))


def block_ids(blocks: DataFrame, snapshot: str = "snapshot_id") -> DataFrame:
    """blocks (snapshot, ord, type, heading, text) with block_id: a digest of the content; repeats get a number."""
    parts = [F.col("type"), F.coalesce("heading_norm", F.lit("")), F.col("text_norm")]
    zero = F.lit("\x00")
    digest = F.concat(F.lit("b-"), F.substring(F.sha2(F.concat(parts[0], zero, parts[1], zero, parts[2]), 256), 1, 12))
    at = Window.partitionBy(snapshot, "digest").orderBy("ord")
    out = blocks.withColumn("digest", digest).withColumn("__k", F.row_number().over(at) - 1)
    return out.withColumn("block_id", F.when(F.col("__k") == 0, F.col("digest")).otherwise(F.concat_ws("-", "digest", F.col("__k").cast("string")))).drop("__k", "digest")


def paragraphs(text: Column) -> Column:
    """Blank lines separate paragraphs; empty ones go."""
    return F.filter(F.transform(F.split(text, rf"\n[{SPACES}&&[^\n]]*\n[{SPACES}]*"), trimmed), lambda x: x != "")


def prose_lines(text: Column) -> Column:
    """Trimmed lines that are not empty, or the whole text where there is none."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n+"), trimmed), lambda x: x != "")
    return let(lines, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(text)))


def sealed(text: Column, key: Column) -> Column:
    """Text between marks that it does not hold: the first of eight marks made from the key; null if all occur."""
    marks = [F.concat(F.lit("seal-"), F.substring(F.sha2(F.concat(key, F.lit(f"-{k}")), 256), 1, 16)) for k in range(8)]
    return F.coalesce(*[F.when(~F.contains(text, m), F.concat(m, F.lit("\n"), text, F.lit("\n"), m)) for m in marks])


def wording(text: Column, unit: Column) -> Column:
    return F.concat_ws(" ", text, F.nullif(unit, F.lit("")))


def string_norm(text: Column) -> Column:
    """Trimmed, folded, white space collapsed, trailing dots off."""
    return F.regexp_replace(F.regexp_replace(F.lower(trimmed(text)), f"[{SPACES}]+", " "), r"\.+$", "")


# Units that count as one.
UNITS = {
    "tsp": ["teaspoon", "teaspoons", "tl", "teelöffel", "teeloeffel"],
    "tbsp": ["tablespoon", "tablespoons", "el", "esslöffel", "essloeffel"],
    "g": ["gram", "grams", "gm", "gramm"],
    "kg": ["kilogram", "kilo", "kilogramm"],
    "ml": ["millilitre", "milliliter"],
    "l": ["litre", "liter"],
    "cup": ["cups", "tasse", "tassen"],
    "clove": ["cloves", "zehe", "zehen"],
    "can": ["cans", "dose", "dosen"],
    "pinch": ["prise", "prisen"],
    "sprig": ["sprigs"],
    "sheet": ["sheets", "blatt", "blätter"],
    "msp": ["messerspitze"],
    "piece": ["stück", "stueck", "stk"],
    "bunch": ["bund"],
    "packet": ["päckchen", "paeckchen", "pckg"],
}
# Fraction signs.
FRACTIONS = {"½": "1/2", "¼": "1/4", "¾": "3/4", "⅓": "1/3", "⅔": "2/3", "⅛": "1/8"}


def unit_norm(unit: Column) -> Column:
    own = string_norm(F.coalesce(unit, F.lit("")))
    pairs = [F.lit(x) for to, names in UNITS.items() for name in names for x in (name, to)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), own), own)


#: A whole amount in one pattern: whole part or decimal, fraction, and the same again after a dash or "to".
_AMOUNT = r"(?:(\d+(?:\.\d+)?)(?![\d./]))?(?: ?(\d+)/(\d+))?"
_QUANTITY = rf"^{_AMOUNT}(?:\s*(-|–|—|to)\s*{_AMOUNT}(?: .*)?)?$"


def quantity_norm(text: Column) -> Column:
    """A comparable form: a number to four places, lo..hi for a range, else the folded wording.

    A number is a whole or decimal part, a fraction, or a whole part and a fraction; what follows a range's second
    number after a space, such as a unit, is left out.
    """
    signs = reduce(lambda x, sign: F.replace(x, F.lit(sign), F.lit(" " + FRACTIONS[sign])), FRACTIONS, text)
    shown = lambda x: F.format_string("%.4f", x)

    def parts(t: Column) -> Column:
        """The pattern's groups, and the text itself."""
        return record(t=t, **{f"g{k}": F.regexp_extract(t, _QUANTITY, k) for k in range(1, 8)})

    def number(p: Column, whole: int) -> Column:
        group = lambda k: F.nullif(p[f"g{k}"], F.lit("")).try_cast("double")
        share = F.try_divide(group(whole + 1), group(whole + 2))
        mixed = F.contains(p[f"g{whole}"], F.lit(".")) & group(whole + 1).isNotNull()
        value = F.when(group(whole + 1).isNull(), group(whole)).otherwise(F.coalesce(group(whole), F.lit(0.0)) + share)
        return F.when(~mixed, value)

    def form(x: Column) -> Column:
        return F.when((x["dash"] != "") & x["low"].isNotNull() & x["high"].isNotNull(), F.concat(shown(x["low"]), F.lit(".."), shown(x["high"]))).when(
            ~(x["dash"] != "") & x["low"].isNotNull(), shown(x["low"])).otherwise(x["t"])

    t = trimmed(F.regexp_replace(F.lower(signs), f"[{SPACES}]+", " "))
    return let(let(let(t, parts), lambda p: record(t=p["t"], dash=p["g4"], low=number(p, 1), high=number(p, 5))), form)
