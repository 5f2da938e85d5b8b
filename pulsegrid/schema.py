"""Table layouts shared by the operators (long form, integer microseconds, SQL NULL for missing)."""

EVENTS = "rec_id string, seq long, x int, y int, p int, t long"
TELEMETRY = "rec_id string, t long, azimuth double, rev int, flag string"
PULSES = "rec_id string, k long, t long"
AUDIO = "rec_id string, i long, amp double"
DETECTIONS = ("rec_id string, step long, t long, cx double, cy double, x0 int, y0 int, "
              "x1 int, y1 int, area long, n_events long")
TRACK = "rec_id string, target_id long, t long, cx double, cy double"

#: microseconds per second
US = 1_000_000
#: width of the time buckets that split a recording for ordered work and for the stored layout
CHUNK_US = 1_000_000
