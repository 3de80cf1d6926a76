"""Words, codes and patterns that results must agree on. Nothing here is logic."""

# Canonical organization names and what else they are called in files and sheets.
ORGANIZATIONS = {
    "Army": ["A", "ARMY"],
    "Navy": ["N", "NAVY", "USN"],
    "Air Force": ["F", "AF", "USAF", "AIR FORCE"],
    "Space Force": ["S", "SPACE FORCE"],
    "Defense-Wide": ["D", "DEFENSE-WIDE", "DEFENSEWIDE", "DW"],
    "Marine Corps": ["M", "USMC", "MARINE CORPS"],
    "Joint Staff": ["J"],
    "SOCOM": ["USSOCOM"],
    "TRANSCOM": ["TRANS"],
}
# Agencies that go by one name.
AGENCIES = (
    "DISA", "DLA", "MDA", "DHA", "NGB", "DARPA", "NSA", "DIA", "NRO", "NGA", "DTRA", "DCSA", "WHS", "DCMA", "DFAS", "DODEA", "DPAA", "TJS", "DSCA",
    "DECA", "OSD", "DAU", "DTIC", "DHRA", "DLSA", "DTSA", "OTE", "CYBER", "CMP", "DEPS", "DEPSDDR", "DMACT", "OLDCC", "CAAF", "CBDP", "SDA", "BTA",
    "DEFW", "DEFR", "OEA", "UNDD", "DPMO", "DSS", "IG", "TMA", "NDU",
)
# Names of the past, where case does not count.
RENAMED = {"dss": "DCSA", "dhp": "DHA", "tma": "DHA", "dpmo": "DPAA"}

# Account titles of one appropriation code.
TITLE_CODES = {
    "O&M": [
        "Operation & Maintenance, Navy", "Operation & Maintenance, Army", "Operation & Maintenance, Air Force", "Operation & Maintenance, Marine Corps",
        "Operation & Maintenance, Space Force", "Operation & Maintenance, Defense-Wide", "Operation & Maintenance, Army Natl Guard",
        "Operation & Maintenance, Army Reserve", "Operation & Maintenance, Navy Res", "Operation & Maintenance, Navy Reserve",
        "Operation & Maintenance, AF Reserve", "Operation & Maintenance, Air Natl Guard", "Operation & Maintenance, MC Reserve",
        "Operation & Maintenance, ARNG", "Operation & Maintenance, ANG", "Operational Test & Eval, Defense",
    ],
    "DHP": ["Defense Health Program"],
    "MILCON": [
        "Mil Con, Def-Wide", "Mil Con, Army", "Mil Con, Navy", "Mil Con, Air Force", "Mil Con, Army Natl Guard", "Mil Con, AF Reserve", "Mil Con, Navy Res",
        "Mil Con, Navy Reserve", "MilCon, Air Force", "MilCon, ANG", "MilCon, AF Res", "MILCON, Army", "MILCON, ARNG", "MILCON, Army R",
    ],
    "RDTE": [
        "RDT&E, Army", "RDT&E, Navy", "RDT&E, Air Force", "RDT&E, Defense-Wide", "RDT&E, Space Force", "RDTE, Space Force",
        "Research, Development, Test, and Evaluation, Space Force",
    ],
    "APAF": ["Aircraft Procurement, Army", "Aircraft Procurement, Navy", "Aircraft Procurement, Air Force"],
    "WPN": ["Weapons Procurement, Navy"],
    "OPROC": ["Other Procurement, Army", "Other Procurement, Navy", "Other Procurement, Air Force"],
    "SCN": ["Shipbuilding & Conversion, Navy", "Shipbuilding and Conversion, Navy"],
    "AMMO": ["Procurement of Ammunition, Army", "Procurement of Ammunition, Navy/MC"],
    "PROC": ["Procurement, Marine Corps", "Procurement, Defense-Wide", "Procurement, Space Force"],
    "MPAF": ["Missile Procurement, Army"],
    "FHSG": ["Fam Hsg O&M, DW", "Fam Hsg O&M, Army", "Fam Hsg O&M, AF", "Fam Hsg O&M, N/MC"],
    "RFUND": [
        "Working Capital Fund, Air Force", "Working Capital Fund, Defense-Wide", "Working Capital Fund, DECA", "Working Capital Fund, Army",
        "Working Capital Fund, Navy", "National Defense Sealift Fund",
    ],
    "CHEM": ["Chem Agents & Munitions Destruction"],
}
# Parts of account titles and their code; the first that occurs counts.
KEYWORD_CODES = [
    ("aircraft procurement", "APAF"), ("missile procurement", "MPAF"), ("weapons procurement", "WPN"), ("ammunition procurement", "AMMO"),
    ("other procurement", "OPROC"), ("shipbuilding and conversion", "SCN"), ("shipbuilding & conversion", "SCN"),
    ("research, development, test & eval", "RDTE"), ("research, development, test and eval", "RDTE"), ("rdt&e", "RDTE"),
    ("operation and maintenance", "O&M"), ("operations and maintenance", "O&M"), ("operation & maintenance", "O&M"),
    ("operations & maintenance", "O&M"), ("operational test & eval", "O&M"), ("operational test and eval", "O&M"),
    ("military personnel", "MILPERS"), ("military construction", "MILCON"), ("mil con", "MILCON"), ("milcon", "MILCON"),
    ("revolving fund", "RFUND"), ("working capital fund", "RFUND"), ("sealift fund", "RFUND"), ("family housing", "FHSG"), ("fam hsg", "FHSG"),
    ("national guard and reserve", "NGRE"), ("chemical agents", "CHEM"), ("chem agents", "CHEM"), ("defense production act", "DPA"),
    ("environmental restoration", "ER"), ("drug interdiction", "DRUG"), ("defense health", "DHP"),
    ("brac", "MILCON"), ("procurement", "PROC"), ("cooperative threat reduction", "O&M"),
    ("inspector general", "O&M"), ("court of appeals", "O&M"), ("overseas humanitarian", "O&M"), ("acquisition workforce", "O&M"),
    ("sporting competitions", "O&M"), ("counter isis", "O&M"), ("improvised explosive device", "O&M"), ("afghanistan security", "O&M"),
    ("lease of dod", "O&M"), ("disposal of dod", "O&M"), ("operational test", "O&M"),
]
# What each appropriation's money is called; the first line with a word that occurs counts.
COLORS = [
    ("RDT&E", ["RDT", "RESEARCH", "DEVELOPMENT", "R&D"]),
    ("Procurement", ["PROCURE"]),
    ("O&M", ["OPER", "MAINT", "O&M"]),
    ("MILCON", ["MILCON", "CONSTRUCTION"]),
    ("Military Personnel", ["MILPERS", "PERSONNEL"]),
]
# Budget activities by the third and fourth digit of a program element of 06.
ACTIVITIES = {
    "01": "BA 1: Basic Research",
    "02": "BA 2: Applied Research",
    "03": "BA 3: Advanced Technology Development",
    "04": "BA 4: Advanced Component Dev & Prototypes",
    "05": "BA 5: System Development & Demonstration",
    "06": "BA 6: RDT&E Management Support",
    "07": "BA 7: Operational Systems Development",
}
# Titles of table rows that are no project, and how such titles begin.
JUNK_TITLES = [
    "Total", "Total PE", "Total PE Cost", "Total Cost", "Total Program Element", "Total Program Element Cost", "Total Program Element (PE)",
    "Total Program Element (PE) Cost", "R-1 SHOPPING LIST - Item No.", "R-1 SHOPPING LIST",
]
JUNK_BEGINNINGS = ["Total ", "R-1 ", "# FY", "MDAP", "MAIS", "Note:", "* ", "Quantity of", "Project MDAP"]
# Texts that give away a page header, within so many characters; the least length of a description.
HEADER_MARKS = ["Exhibit R-1", "President's Budget", "Total Obligational Authority", "R D T & E Program Exhibit", "RDT&E PROGRAM EXHIBIT"]
HEADER_WITHIN, LEAST_DESCRIPTION = 300, 80
# A program element's letters behind its seven digits; signs and words of query syntax.
PE_LETTERS = "(?:[A-Z]{1,2}|[A-Z][0-9][A-Z])"
QUERY_SIGNS, QUERY_WORDS = '"()*:^+', ["AND", "OR", "NOT", "NEAR"]
# Cells that stand for no amount.
NO_AMOUNT = ["-", "--", "TBD", "N/A", "Continuing", "CONTINUING", "Complete", "Cost"]
# Precedence of the kinds of amount, the best first.
AMOUNT_KINDS = ["actual", "enacted", "supplemental", "total", "request", "reconciliation"]
