"""Word pools for the text generators.

No Faker is available on executors, so names, places and words are drawn from
these fixed lists (shipped inside the plan as constant arrays)."""

# Status vocabularies by column-name keyword, in lookup order.
STATUS_VALUES = (
    ("order", ("created", "paid", "packed", "shipped", "delivered", "cancelled")),
    ("payment", ("initiated", "authorized", "captured", "failed", "refunded")),
    ("ticket", ("open", "pending", "resolved", "closed")),
    ("case", ("open", "pending", "resolved", "closed")),
    ("shipment", ("label_created", "in_transit", "out_for_delivery", "delivered", "returned")),
)
DEFAULT_STATUS = ("active", "inactive", "pending", "failed")

FIRST_NAMES = (
    "James", "Mary", "Robert", "Patricia", "John", "Jennifer", "Michael", "Linda",
    "David", "Elizabeth", "William", "Barbara", "Richard", "Susan", "Joseph", "Jessica",
    "Thomas", "Sarah", "Charles", "Karen", "Daniel", "Lisa", "Matthew", "Nancy",
    "Anthony", "Betty", "Mark", "Sandra", "Donald", "Ashley", "Steven", "Kimberly",
    "Andrew", "Emily", "Joshua", "Donna", "Kevin", "Michelle", "Brian", "Carol",
    "Maria", "Jose", "Wei", "Aisha", "Omar", "Priya", "Hiro", "Lucia",
)
LAST_NAMES = (
    "Smith", "Johnson", "Williams", "Brown", "Jones", "Garcia", "Miller", "Davis",
    "Rodriguez", "Martinez", "Hernandez", "Lopez", "Gonzalez", "Wilson", "Anderson",
    "Thomas", "Taylor", "Moore", "Jackson", "Martin", "Lee", "Perez", "Thompson",
    "White", "Harris", "Sanchez", "Clark", "Ramirez", "Lewis", "Robinson", "Walker",
    "Young", "Allen", "King", "Wright", "Scott", "Torres", "Nguyen", "Hill", "Flores",
    "Green", "Adams", "Nelson", "Baker", "Hall", "Rivera", "Campbell", "Mitchell",
)
EMAIL_DOMAINS = ("example.com", "example.net", "example.org", "mail.test", "inbox.test")
CITIES = (
    "Springfield", "Riverside", "Franklin", "Greenville", "Bristol", "Clinton",
    "Fairview", "Salem", "Madison", "Georgetown", "Arlington", "Ashland", "Dover",
    "Oxford", "Jackson", "Burlington", "Manchester", "Milton", "Newport", "Auburn",
    "Dayton", "Lexington", "Milford", "Winchester", "Hudson", "Kingston", "Marion",
    "Mount Vernon", "Lebanon", "Centerville",
)
COUNTRIES = (
    "United States", "Canada", "Mexico", "Brazil", "Argentina", "United Kingdom",
    "Ireland", "France", "Germany", "Spain", "Portugal", "Italy", "Netherlands",
    "Belgium", "Sweden", "Norway", "Denmark", "Finland", "Poland", "Greece", "Turkey",
    "Egypt", "Nigeria", "Kenya", "South Africa", "India", "China", "Japan",
    "South Korea", "Vietnam", "Thailand", "Indonesia", "Australia", "New Zealand",
)
WORDS = (
    "alpha", "bridge", "cable", "delta", "ember", "field", "grove", "harbor", "island",
    "jungle", "kernel", "lantern", "meadow", "nickel", "orbit", "prairie", "quartz",
    "river", "summit", "timber", "urban", "valley", "willow", "yellow", "zenith",
    "anchor", "beacon", "canyon", "dune", "echo", "falcon", "glacier", "horizon",
    "ivory", "jasper", "kayak", "lagoon", "marble", "nectar", "oasis", "pebble",
)
COMPANY_KINDS = ("Inc", "Ltd", "Group", "and Sons", "LLC", "Partners", "Works", "Holdings")
STREET_KINDS = ("Street", "Avenue", "Road", "Lane", "Drive", "Court", "Square", "Way")
STATES = (
    "Alabama", "Arizona", "California", "Colorado", "Florida", "Georgia", "Illinois", "Indiana",
    "Iowa", "Kansas", "Maine", "Maryland", "Michigan", "Minnesota", "Nevada", "New York",
    "Ohio", "Oregon", "Texas", "Utah", "Vermont", "Virginia", "Washington", "Wisconsin",
)
JOBS = (
    "Accountant", "Architect", "Baker", "Carpenter", "Chemist", "Designer", "Editor", "Electrician",
    "Engineer", "Farmer", "Librarian", "Mechanic", "Nurse", "Pharmacist", "Pilot", "Plumber",
    "Surveyor", "Teacher", "Translator", "Welder",
)
CURRENCIES = ("USD", "EUR", "GBP", "JPY", "CHF", "CAD", "AUD", "SEK", "NOK", "DKK", "PLN", "INR", "CNY", "BRL", "MXN", "ZAR")
