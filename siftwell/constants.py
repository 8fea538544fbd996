"""Values that are part of the semantics."""

# They must equal the established ones for results to agree.
FORMATS = ("in_person", "online", "hybrid", "unknown")
REGISTRATION_STATES = ("open", "closed", "waitlist", "sold_out", "cancelled", "postponed", "unknown")
EVENT_TYPES = ("talk", "meetup", "workshop", "conference", "hackathon", "buildathon", "competition", "unknown")
TRUST_RANK = {"low": 1, "medium": 2, "high": 3}
TERMINAL_STATES = ("cancelled", "sold_out", "closed", "postponed")
SEVERITY = {"unknown": 0, "open": 1, "waitlist": 2, "closed": 3, "sold_out": 4, "postponed": 5, "cancelled": 6}
EXCLUDED_TERMS = (
    "product management", "product meetup", "founder", "startup pitch", "pitch night", "sales", "career fair", "job fair",
    "networking mixer", "networking event",
)
INELIGIBLE_TERMS = ("students only", "student-only", "employees only", "employee-only", "invite only", "private event")
APPROVAL_TERMS = ("approval required", "application review", "subject to approval", "apply to attend")
CITY_WORDS = ("bengaluru", "bangalore", "blr")
TRACKING_PREFIX = "utm_"
TRACKING_KEYS = ("fbclid", "gclid", "mc_eid", "igshid")
MEETUP_TRACKING_KEYS = ("recid", "recsource", "searchid", "eventorigin")
TYPE_WORDS = (
    ("buildathon", "buildathon"), ("hackathon", "hackathon"), ("competition", "competition"), ("challenge", "competition"),
    ("workshop", "workshop"), ("hands-on", "workshop"), ("conference", "conference"), ("summit", "conference"), ("meetup", "meetup"),
    ("talk", "talk"), ("speaker", "talk"), ("session", "talk"), ("webinar", "talk"),
)
MATERIAL_FIELDS = {
    "registration_state": "registration_state", "registration_url": "registration_url", "registration_opened_at": "registration_opened",
    "first_observed_open_at": "registration_opened", "starts_at": "schedule", "ends_at": "schedule", "venue": "venue", "format": "format",
    "registration_deadline": "registration_deadline", "price_status": "price", "status": "lifecycle",
}
CHUNK_CHARS, ATTEMPTS, PAGE_BYTES, ROBOTS_BYTES = 4000, 3, 8 << 20, 512 << 10
NEAR_DAYS, EXTENDED_DAYS, OPENED_DAYS, DASHBOARD_LIMIT, MINIMUM_SCORE, DIGEST_LIMIT = 60, 180, 7, 100, 3, 10
IST = "Asia/Kolkata"
