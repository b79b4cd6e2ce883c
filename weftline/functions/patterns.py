"""Patterns that several operators share, in Java's dialect."""

# fixed values: emoji and pictographs
EMOJI = (
    "[\\x{1F300}-\\x{1F5FF}\\x{1F600}-\\x{1F64F}\\x{1F680}-\\x{1F6FF}\\x{1F700}-\\x{1F77F}\\x{1F780}-\\x{1F7FF}\\x{1F800}-\\x{1F8FF}"
    "\\x{1F900}-\\x{1F9FF}\\x{1FA00}-\\x{1FA6F}\\x{1FA70}-\\x{1FAFF}\\x{1F1E6}-\\x{1F1FF}\\x{1F3FB}-\\x{1F3FF}\\x{2702}-\\x{27B0}"
    "\\x{2600}-\\x{26FF}\\x{FE0F}\\x{200D}]+"
)
