"""Tables the jobs exchange, as DDL."""

SAMPLES = "subject string, recording string, channel string, i bigint, value double"
SEIZURES = "subject string, recording string, onset_sec double, offset_sec double"
WINDOWS = (
    "subject string, recording string, k bigint, channel string, start_sec double,"
    " x array<float>, y int"
)
SCORED = "subject string, recording string, k bigint, y int, prob double, pred int"
