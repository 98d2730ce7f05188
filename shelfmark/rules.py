"""Rule lists and vocabularies that operators take as defaults; all can be replaced by arguments."""

# Qualifiers of a performance, in order of precedence.
QUALIFIERS = (
    (r"\bset\s*1\b|\bset\s*one\b|\b1st\s*set\b", "Set 1"),
    (r"\bset\s*2\b|\bset\s*two\b|\b2nd\s*set\b", "Set 2"),
    (r"\bset\s*3\b|\bset\s*three\b|\b3rd\s*set\b", "Set 3"),
    (r"\bearly\b", "Early Show"),
    (r"\blate\b", "Late Show"),
    (r"\bafternoon\b", "Afternoon Show"),
    (r"\bevening\b", "Evening Show"),
    (r"\bacoustic\b", "Acoustic Set"),
    (r"\belectric\b", "Electric Set"),
    (r"\bmatinee\b", "Matinee"),
    (r"\bsoundcheck\b", "Soundcheck"),
    (r"\brehearsal\b", "Rehearsal"),
)

# Markers of a value that says "unknown".
UNKNOWN_MARKERS = (
    "unknown", "track", "artiste inconnu", "artista desconocido", "interprete desconocido", "artista sconosciuto",
    "artista desconhecido", "unbekannter kunstler", "kunstler unbekannt", "onbekende artiest", "inconnu", "inconnue",
    "inconnus", "inconnues", "desconocido", "desconocida", "desconocidos", "desconocidas", "sconosciuto",
    "sconosciuta", "sconosciuti", "sconosciute", "desconhecido", "desconhecida", "desconhecidos", "desconhecidas",
    "unbekannt", "unbekannte", "unbekannter", "onbekend", "onbekende", "ukjent",
)

# Phrase of a placeholder document.
PLACEHOLDER = "folder never contained an info file"

# Lines of a list of titles, and lines of checksums.
LIST_LINES = (r"^\s*\d{1,2}[.) -]+\s*\S+", r"(?i)^\s*d[0-9]+t[0-9]+", r"(?i)set\s*1|set\s*2|encore", r"(?i)^\s*disc\s*\d+", r"(?i)^\s*cd\s*\d+")
CHECKSUM_LINES = (r"^[a-fA-F0-9]{16,128}\s+[* ]?.+$", r"^.+?\s*[:=]\s*[a-fA-F0-9]{16,128}$", r"^[a-fA-F0-9]{8,128}$", r"^[a-fA-F0-9]{8}\s+.+$")
HOUSEKEEPING_WORDS = "md5|ffp|checksum|torrent|spectrogram|aucdtect|sfv|m3u|m3u8|pls|cue|log"

# Labels of header fields.
FIELD_LABELS = {"artist": "artist", "band": "artist", "performer": "artist", "date": "date", "venue": "venue", "place": "venue", "location": "location", "city": "location"}
