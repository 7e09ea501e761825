"""Fixed Java vocabulary and token predicates as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# The Java reserved words that the identifier test rejects: the union of the
# keyword, basic-type and modifier sets of the public ``javalang`` tokenizer
# (basic types and modifiers are already keywords).  50 words, alphabetical.
# ``true``, ``false`` and ``null`` are literals, not keywords, so they count as
# identifiers.
JAVA_RESERVED = (
    "abstract", "assert", "boolean", "break", "byte", "case", "catch", "char",
    "class", "const", "continue", "default", "do", "double", "else", "enum",
    "extends", "final", "finally", "float", "for", "goto", "if", "implements",
    "import", "instanceof", "int", "interface", "long", "native", "new",
    "package", "private", "protected", "public", "return", "short", "static",
    "strictfp", "super", "switch", "synchronized", "this", "throw", "throws",
    "transient", "try", "void", "volatile", "while",
)

# Quote tokens that open and close a string region in the token folds.
QUOTES = ('"', "'")

# Statement terminators for segmentation.
TERMINATORS = ("{", "}", ";")

# The exception pattern of the catch-clause extractor (first match wins).
CATCH_PATTERN = r"catch\s*\(\s*(?:final\s+)?([\w.|s]+)\s+([\w]+)\s*\)"

# The ten exception classes of the shipped reverse map, id order.
EXCEPTION_CLASSES = (
    "Exception", "IOException", "InterruptedException",
    "IllegalArgumentException", "SQLException", "NumberFormatException",
    "RuntimeException", "ClassNotFoundException", "AssertionError",
    "RemoteException",
)

# Characters that Python's ``str.strip()`` / ``str.split()`` treat as
# whitespace (``str.isspace``), written as a regex character class.
PY_SPACE_CLASS = (
    r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# The same characters as a string.
PY_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) \
    + "\u2028\u2029\u202f\u205f\u3000"
# ----------------------------------------------------------------------------


def is_identifier(tok: Column) -> Column:
    """Starts with a word character, not with a digit, and is not reserved.

    ASCII classes, as Spark's and DuckDB's ``\\w``/``\\d``: the first
    character is a letter or ``_``.  Tested on the first character's code
    (no regex), since this runs per token inside array lambdas.  A null token
    is not an identifier.
    """
    a = F.ascii(tok)
    first = a.between(65, 90) | a.between(97, 122) | (a == 95)
    return F.coalesce(first & ~tok.isin(*JAVA_RESERVED), F.lit(False))
