"""Column names, types and aliases of the two input tables."""

from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

PURCHASE = "purchase"
PLAY = "play"

# Interaction logs have no header: five columns by position. Hours arrive as text, since one bad
# cell must become NULL and not fail or retype the column; user ids too, as logs may name users; `extra` is constant and gets dropped.
RAW_INTERACTIONS = StructType([
    StructField("user_id", StringType()),
    StructField("item", StringType()),
    StructField("behavior", StringType()),
    StructField("hours", StringType()),
    StructField("extra", StringType()),
])

INTERACTIONS = StructType([
    StructField("user_id", LongType()),
    StructField("item", StringType()),
    StructField("behavior", StringType()),
    StructField("hours", DoubleType()),
])

# Catalogue column names that are accepted, in order of preference.
TITLE_NAMES = ("title", "name", "game", "game_title", "gametitle", "product", "spiel", "spielname")
METASCORE_NAMES = ("metascore", "critic_score", "critic_score_avg")
USERSCORE_NAMES = ("userscore", "user_score")
RELEASE_NAMES = ("release_date", "release", "released", "release_year", "jahr", "year")
GENRE_NAMES = ("genre", "genres", "category", "categories")

# Encodings tried for a catalogue file.
ENCODINGS = ("utf-8", "utf-8-sig", "latin-1")

# Labels of the retention report.
QUADRANTS = ("Oben Rechts", "Oben Links", "Unten Rechts", "Unten Links")
LOW_RETENTION_LABEL = "Niedrig (<{low}%)"
MID_RETENTION_LABEL = "Mittel ({low}-{high}%)"
HIGH_RETENTION_LABEL = "Hoch (>{high}%)"
