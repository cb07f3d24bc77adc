"""Fixed values of the page layouts: header roles, banners, labels, thresholds. They are data, by source."""

from __future__ import annotations

# Section headers of each source and their content types.
HEADERS = {
    "pilot": {
        "WHAT THIS UNIT IS ABOUT": "aim",
        "WHAT ARE THE PRE-REQUISITES FOR THIS UNIT?": "admin",
        "KEY MESSAGES": "key_messages",
        "PILOT GUIDE FOR THIS UNIT": "theory",
        "FLIGHT EXERCISES FOR THIS UNIT": "exercise",
        "THINGS YOU MIGHT HAVE DIFFICULTY WITH": "common_problems",
        "HOW DO YOU DEMONSTRATE COMPETENCE?": "competency",
        "RESOURCES & REFERENCES": "admin",
        "COMPLEMENTARY UNITS": "admin",
        "SELF-CHECK QUESTIONS": "self_check",
        "THREAT AND ERROR MANAGEMENT": "airmanship",
        "COMMON PROBLEMS": "common_problems",
        "FLIGHT EXERCISES": "exercise",
        "EXERCISES FOR THIS UNIT": "exercise",
        "PERSONAL PREPARATION": "briefing",
        "GLIDER PREPARATION": "briefing",
        "TRAILER AND RETRIEVE PREPARATION": "briefing",
        "TASK PLANNER": "exercise",
    },
    "trainer": {
        "AIM": "aim",
        "PREREQUISITE UNITS": "admin",
        "PRE-REQUISITE UNITS": "admin",
        "WHAT ARE THE PRE-REQUISITES FOR THIS UNIT?": "admin",
        "RECOGNITION OF PRIOR LEARNING": "admin",
        "RADIOTELEPHONE OPERATOR AUTHORISATION": "admin",
        "COMPLEMENTARY UNITS": "admin",
        "KEY MESSAGES": "key_messages",
        "LESSON PLANNING AND CONDUCT": "briefing",
        "PRE-FLIGHT BRIEFING": "briefing",
        "BRIEFING": "briefing",
        "INSTRUCTOR NOTES": "briefing",
        "TRAINING NOTES AND LESSON PLANNING FOR POWERED SAILPLANE PILOTS": "briefing",
        "FLIGHT EXERCISES": "exercise",
        "STUDENT EXERCISES": "exercise",
        "EXERCISES": "exercise",
        "PERSONAL PREPARATION": "briefing",
        "GLIDER PREPARATION": "briefing",
        "TRAILER AND RETRIEVE PREPARATION": "briefing",
        "CHECKLIST": "briefing",
        "SEARCH AND RESCUE": "theory",
        "BASIC NAVIGATION PRINCIPLES": "theory",
        "THREAT AND ERROR MANAGEMENT": "airmanship",
        "COMMON PROBLEMS": "common_problems",
        "COMPETENCY ELEMENTS AND PERFORMANCE STANDARDS": "competency",
        "TRAINING MATERIALS AND REFERENCES": "admin",
    },
}
# Sections that may be printed below section size.
SMALL_SECTIONS = {
    "trainer": ["AIM", "PREREQUISITE UNITS", "COMPLEMENTARY UNITS", "KEY MESSAGES", "LESSON PLANNING AND CONDUCT", "PRE-FLIGHT BRIEFING", "FLIGHT EXERCISES", "THREAT AND ERROR MANAGEMENT", "COMMON PROBLEMS", "COMPETENCY ELEMENTS AND PERFORMANCE STANDARDS", "TRAINING MATERIALS AND REFERENCES"],
    "pilot": ["WHAT THIS UNIT IS ABOUT", "WHAT ARE THE PRE-REQUISITES FOR THIS UNIT?", "KEY MESSAGES", "PILOT GUIDE FOR THIS UNIT", "FLIGHT EXERCISES FOR THIS UNIT", "THINGS YOU MIGHT HAVE DIFFICULTY WITH", "HOW DO YOU DEMONSTRATE COMPETENCE?", "RESOURCES & REFERENCES", "COMPLEMENTARY UNITS", "SELF-CHECK QUESTIONS"],
}
# Sub-headings that are printed without bold.
PLAIN_SUBHEADINGS = {"pilot": ["COMMON PROBLEMS"]}
# Running banners.
BANNERS = ["GLIDING AUSTRALIA TRAINING MANUAL", "TRAINER GUIDE", "PILOT GUIDE"]
# Labels inside figures, by source and unit.
FIGURE_LABELS = {
    ("pilot", "5"): ["Rotation of", "Control Movement", "Control Surface Position", "Force on an aircraft axis of", "aircraft around an", "that", "resulting", "changes", "rotation", "in", "creates", "axis."],
    ("pilot", "9"): ["1.5 Km", "700", "m"],
    ("pilot", "34"): ["WSSSSSS", "Field Selection Check list"],
}
# Header rows of two-column tables.
TABLE_HEADERS = ["ELEMENT PERFORMANCE STANDARDS", "ELEMENT PERFORMANCE STANDARD", "PROBLEM PROBABLE CAUSE", "PROBLEM SOLUTION", "PROBLEM SOLUTIONS", "PROBLEM ACTIONS REQUIRED"]
# Footers that print another unit's number (source, printed, actual).
FOOTER_CORRECTIONS = [("pilot", 37, 38)]
# Line patterns.
FOOTER = r"Page\s*(\d+)\s*([A-Z])?\s*-\s*(\d+)"
REVISION = r"Revision:?\s+([0-9.]+)"
HEADER_UNIT = r"(?m)^Unit\s+(\d{1,2})\s*[-–]"
UNIT_TITLE = r"^Unit\s+\d+\s*[A-Z]?\s*(?:[-–].*)?$"
FOOTER_LINE = r"^(?:Revision:?\s+[0-9.]+|(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}|Page\s*\d+\s*[A-Z]?\s*-\s*\d+)$"
PATTER = "SUGGESTED PATTER"
# Sizes and distances in points.
SECTION_SIZE, FOOTER_SIZE = 13.0, 8.5
HEADER_BAND = 140.0
COLUMN_GAP, WRAP_GAP = 50.0, 5.0
