"""Column types of the input tables; extra columns in a file are kept as text.

Fixed values: the column names are those of the input files.
"""

from pyspark.sql import types as T


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in columns.items()])


_S, _D, _DAY, _TS = T.StringType(), T.DoubleType(), T.DateType(), T.TimestampType()

GAME_LOGS = _schema(
    game_id=_S, game_date=_DAY, season=_S, player_id=_S, player_name=_S, team=_S, opponent=_S,
    home_away=_S, pts=_D, fg3m=_D, ast=_D, reb=_D, minutes=_D,
)
GAME_LOGS_REQUIRED = ("game_id", "game_date", "player_id", "pts", "fg3m", "ast", "reb")

QUOTED_LINES = _schema(
    game_id=_S, game_date=_DAY, player_id=_S, stat=_S, line=_D, over_odds=_D, under_odds=_D, book=_S,
)
QUOTED_LINES_REQUIRED = ("game_id", "game_date", "player_id", "stat", "line")

TICKET_LEGS = _schema(
    builder_id=_S, leg_id=_S, game_id=_S, game_date=_DAY, player_id=_S, stat=_S, direction=_S,
    line=_D, builder_total_odds=_D, stake=_D,
)
TICKET_LEGS_REQUIRED = ("builder_id", "game_id", "game_date", "player_id", "stat", "direction", "line")

SEASON_BOX = _schema(
    firstName=_S, lastName=_S, personId=_S, gameId=_S, gameDate=_TS, playerteamCity=_S,
    playerteamName=_S, opponentteamCity=_S, opponentteamName=_S, win=_D, home=_D, numMinutes=_D,
    points=_D, assists=_D, reboundsTotal=_D, threePointersMade=_D, threePointersAttempted=_D,
    steals=_D, blocks=_D, turnovers=_D, fieldGoalsMade=_D, fieldGoalsAttempted=_D,
    freeThrowsMade=_D, freeThrowsAttempted=_D, plusMinusPoints=_D,
)

PROP = T.StructType([
    T.StructField("player", _S), T.StructField("stat", _S), T.StructField("line", _D),
    T.StructField("over", T.BooleanType()),
])
TEMPLATE_LEG = T.StructType([T.StructField("name", _S), T.StructField("props", T.ArrayType(PROP))])
TEMPLATE = T.StructType([T.StructField("name", _S), T.StructField("legs", T.ArrayType(TEMPLATE_LEG))])
TICKET = T.StructType([
    T.StructField("date", _DAY), T.StructField("odds", _D), T.StructField("props", T.ArrayType(PROP)),
])
