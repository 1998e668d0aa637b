"""Constants and small dimensions of the risk model."""

from __future__ import annotations

#: name, weight, role
CAPABILITIES = [
    ("fs:read", 5, "source"),
    ("fs:write", 10, "sink"),
    ("network", 15, "source"),
    ("exec", 20, "sink"),
    ("env", 5, "source"),
    ("unsafe", 25, "sink"),
    ("crypto", 5, "sanitizer"),
    ("reflect", 5, "neutral"),
    ("plugin", 20, "sink"),
]
NAMES = [c[0] for c in CAPABILITIES]

#: source, sink, risk, what it means; in order of declaration
TAINT_RULES = [
    ("env", "exec", "HIGH", "environment reaches a command"),
    ("network", "exec", "HIGH", "remote input reaches a command"),
    ("fs:read", "exec", "HIGH", "file content reaches a command"),
    ("network", "unsafe", "HIGH", "remote input steers memory"),
    ("network", "fs:write", "MEDIUM", "remote input lands on disk"),
    ("fs:read", "network", "MEDIUM", "files leave over the network"),
    ("env", "fs:write", "LOW", "environment in a written path"),
    ("network", "plugin", "HIGH", "remote code as a plugin"),
    ("fs:read", "plugin", "HIGH", "a file decides what is loaded"),
    ("env", "crypto", "MEDIUM", "key material from the environment"),
    ("network", "reflect", "MEDIUM", "remote input steers reflection"),
    ("fs:read", "unsafe", "HIGH", "file content steers memory"),
    ("env", "network", "MEDIUM", "environment names the endpoint"),
]

HIGH, MEDIUM = 30, 10
HOPS = (1.00, 0.70, 0.55, 0.40)
MAX_HOPS = 3
LOW_CONFIDENCE = 0.70
RISKY_LICENSES = ["GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.1", "LGPL-3.0", "EUPL-1.1", "EUPL-1.2", "CCDL-1.0"]
RETENTION = 100
