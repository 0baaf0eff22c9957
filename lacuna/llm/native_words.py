"""Words of a text as Spark's own expressions give them, for operators without Python."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna.llm.common import whole_text

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What stands between words once A-Z are in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(column: str = "text") -> Column:
    """All words of the whole text, A-Z in lower case and every other character as it is."""
    lowered = F.translate(whole_text(column), UPPER, UPPER.lower())
    return F.array_remove(F.split(lowered, BETWEEN), "")
