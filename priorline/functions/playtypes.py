"""Provider play-type families. Membership in a family defines a play flag."""

KICKOFF = ["Kickoff", "Kickoff Return (Offense)", "Kickoff Return Touchdown"]
PUNT = ["Punt", "Punt Return", "Blocked Punt", "Punt Return Touchdown", "Blocked Punt Touchdown"]
FIELD_GOAL = [
    "Field Goal Good", "Field Goal Missed", "Blocked Field Goal", "Missed Field Goal Return",
    "Missed Field Goal Return Touchdown", "Blocked Field Goal Touchdown",
]
EXTRA_POINT = ["Extra Point Good", "Extra Point Missed"]
SPECIAL_TEAMS = KICKOFF + PUNT + FIELD_GOAL + EXTRA_POINT
TWO_POINT = ["Two Point Pass", "Two Point Rush", "Defensive 2pt Conversion"]
END_OF_DRIVE = [
    "Punt", "Field Goal Good", "Field Goal Missed", "Blocked Field Goal", "Blocked Punt",
    "Punt Return Touchdown", "Blocked Punt Touchdown", "Missed Field Goal Return",
    "Blocked Field Goal Touchdown", "Missed Field Goal Return Touchdown",
]
INTERCEPTION = ["Interception", "Interception Return Touchdown", "Pass Interception Return"]
FUMBLE_LOST = ["Fumble Recovery (Opponent)", "Fumble Return Touchdown"]
TURNOVER = INTERCEPTION + FUMBLE_LOST
RUSH_ATTEMPT = ["Rush", "Rushing Touchdown"]
RUSH_RESULT = RUSH_ATTEMPT + ["Sack", "Safety"]
DROPBACK = INTERCEPTION + ["Pass", "Passing Touchdown", "Pass Incompletion", "Pass Reception", "Sack"]
PASS_ATTEMPT = INTERCEPTION + [
    "Pass", "Pass Completion", "Passing Touchdown", "Pass Incompletion", "Pass Reception",
]
COMPLETION = ["Pass Reception", "Pass Completion", "Pass", "Passing Touchdown"]
HAVOC = INTERCEPTION + FUMBLE_LOST + ["Fumble Recovery (Own)", "Pass Incompletion"]
DEAD = ["Timeout", "Uncategorized", "placeholder", "End Period"]
SCRIMMAGE_RESULT = [
    "Rush", "Rushing Touchdown", "Fumble Recovery (Own)", "Pass", "Pass Reception",
    "Pass Incompletion", "Passing Touchdown", "Sack", "Safety",
]
NEVER_EXPLOSIVE = TURNOVER + ["Safety"]
OWN_OR_LOST_FUMBLE = ["Fumble Recovery (Own)", "Fumble Recovery (Opponent)"]

FLAGS = {
    "st_kickoff": KICKOFF,
    "st_punt": PUNT,
    "st_fg": FIELD_GOAL,
    "st": SPECIAL_TEAMS,
    "endofdrive": END_OF_DRIVE,
    "twopoint": TWO_POINT,
    "turnover": TURNOVER,
    "fumble_turnover": FUMBLE_LOST,
    "interception_turnover": INTERCEPTION,
    "rush_attempt": RUSH_ATTEMPT,
    "rush_result": RUSH_RESULT,
    "dropback": DROPBACK,
    "pass_attempt": PASS_ATTEMPT,
}
