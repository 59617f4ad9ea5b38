"""Tables of words, patterns and labels that results are defined by."""

from __future__ import annotations

# File extensions that a title may carry.
KNOWN_EXTENSIONS = (
    ".pdf",
    ".epub",
    ".mobi",
    ".azw",
    ".azw3",
    ".djvu",
    ".fb2",
    ".ibooks",
    ".cbr",
    ".cbz",
    ".txt",
    ".rtf",
    ".doc",
    ".docx",
    ".odt",
    ".md",
    ".markdown",
    ".zip",
    ".rar",
    ".7z",
    ".tar",
    ".gz",
    ".csv",
    ".json",
    ".py",
    ".html",
    ".htm",
)

# Display names of extensions.
FILE_TYPES = {
    ".pdf": "PDF",
    ".epub": "EPUB",
    ".mobi": "MOBI",
    ".azw": "AZW",
    ".azw3": "AZW3",
    ".djvu": "DJVU",
    ".fb2": "FB2",
    ".ibooks": "iBooks",
    ".cbr": "CBR",
    ".cbz": "CBZ",
    ".txt": "Text",
    ".rtf": "RTF",
    ".doc": "Word",
    ".docx": "Word (DOCX)",
    ".odt": "ODT",
    ".md": "Markdown",
    ".markdown": "Markdown",
    ".zip": "ZIP Archive",
    ".rar": "RAR Archive",
    ".7z": "7Z Archive",
    ".tar": "TAR Archive",
    ".gz": "GZ Archive",
    ".csv": "CSV Spreadsheet",
    ".json": "JSON Data",
    ".py": "Python Script",
    ".html": "HTML Document",
    ".htm": "HTML Document",
}

# Words with a spelling of their own in titles.
WORD_CASES = {
    "ai": "AI",
    "ml": "ML",
    "llm": "LLM",
    "nlp": "NLP",
    "sql": "SQL",
    "aws": "AWS",
    "api": "API",
    "iot": "IoT",
    "cad": "CAD",
    "autocad": "AutoCAD",
    "pdf": "PDF",
    "csv": "CSV",
    "json": "JSON",
    "bom": "BOM",
    "usb": "USB",
    "html": "HTML",
    "css": "CSS",
    "php": "PHP",
    "ui": "UI",
    "ux": "UX",
    "diy": "DIY",
    "esp32": "ESP32",
    "esp8266": "ESP8266",
    "stm32": "STM32",
    "arm": "ARM",
    "fpga": "FPGA",
    "dsp": "DSP",
    "asic": "ASIC",
    "pcb": "PCB",
    "rf": "RF",
    "cnc": "CNC",
    "ic": "IC",
    "led": "LED",
    "oled": "OLED",
    "lcd": "LCD",
    "ssmp": "SSMP",
    "bacto": "Bacto",
    "edm": "EDM",
    "midi": "MIDI",
    "wifi": "Wi-Fi",
    "wi-fi": "Wi-Fi",
    "os": "OS",
    "dos": "DOS",
    "ip": "IP",
    "tcp": "TCP",
    "udp": "UDP",
    "http": "HTTP",
    "https": "HTTPS",
    "ssh": "SSH",
    "gpu": "GPU",
    "cpu": "CPU",
    "ram": "RAM",
    "rom": "ROM",
    "eeprom": "EEPROM",
    "flash": "Flash",
    "lidar": "LiDAR",
    "gps": "GPS",
    "3d": "3D",
    "2d": "2D",
    "4d": "4D",
    "5g": "5G",
    "4g": "4G",
    "lte": "LTE",
    "c++": "C++",
    "c#": "C#",
    ".net": ".NET",
    "dotnet": ".NET",
    "python": "Python",
    "javascript": "JavaScript",
    "typescript": "TypeScript",
    "node.js": "Node.js",
    "react": "React",
    "vue": "Vue",
    "linux": "Linux",
    "ubuntu": "Ubuntu",
    "debian": "Debian",
    "macos": "macOS",
    "ios": "iOS",
    "android": "Android",
    "docker": "Docker",
    "kubernetes": "Kubernetes",
    "git": "Git",
    "github": "GitHub",
    "gitlab": "GitLab",
    "raspberry": "Raspberry",
    "pi": "Pi",
    "arduino": "Arduino",
    "teensy": "Teensy",
    "adafruit": "Adafruit",
    "oreilly": "O'Reilly",
    "o'reilly": "O'Reilly",
    "mcgraw-hill": "McGraw-Hill",
    "wiley": "Wiley",
    "packt": "Packt",
    "apress": "Apress",
    "manning": "Manning",
    "sybex": "Sybex",
    "devops": "DevOps",
    "cybersecurity": "Cybersecurity",
    "datascience": "Data Science",
    "deeplearning": "Deep Learning",
    "machinelearning": "Machine Learning",
    "microservices": "Microservices",
    "blockchain": "Blockchain",
    "microprocessor": "Microprocessor",
    "synthesizer": "Synthesizer",
    "calisthenics": "Calisthenics",
    "bushcraft": "Bushcraft",
    "pentesters": "Pentesters",
    "pentesting": "Pentesting",
    "pentest": "Pentest",
    "prepper": "Prepper",
    "preppers": "Preppers",
    "blackanddecker": "Black & Decker",
    "ebook": "eBook",
    "bi": "BI",
    "it": "IT",
    "udemy": "Udemy",
    "pichkalyov": "Pichkalyov",
}

# Words in lower case inside a title.
SMALL_WORDS = (
    "a",
    "an",
    "the",
    "and",
    "but",
    "or",
    "nor",
    "for",
    "so",
    "yet",
    "as",
    "at",
    "by",
    "in",
    "of",
    "off",
    "on",
    "per",
    "to",
    "up",
    "via",
    "with",
    "from",
    "into",
    "onto",
    "over",
    "than",
)

# Phrase rewrites, in order, any case (group references as in Java).
PHRASES = (
    (r"\bhands\s*on\b", "Hands-On"),
    (r"\bstep\s*by\s*step\b", "Step-by-Step"),
    (r"\ball\s*in\s*one\b", "All-in-One"),
    (r"\breal\s*time\b", "Real-Time"),
    (r"\bopen\s*source\b", "Open-Source"),
    (r"\bself\s*taught\b", "Self-Taught"),
    (r"\bend\s*to\s*end\b", "End-to-End"),
    (r"\bobject\s*oriented\b", "Object-Oriented"),
    (r"\bfull\s*stack\b", "Full-Stack"),
    (r"\bpeer\s*to\s*peer\b", "Peer-to-Peer"),
    (r"\bstate\s*of\s*the\s*art\b", "State-of-the-Art"),
    (r"\bplug\s*and\s*play\b", "Plug-and-Play"),
    (r"\bcommand\s*line\b", "Command-Line"),
    (r"\bclutter\s*free\b", "Clutter-Free"),
    (r"\buser\s*guide\b", "User Guide"),
    (r"\bcheat\s*sheet\b", "Cheat Sheet"),
    (r"\bauto\s*cad\b", "AutoCAD"),
    (r"\braspberry\s*pi\b", "Raspberry Pi"),
    (r"\bblack\s*and\s*decker\b", "Black & Decker"),
    (r"\b(\d+)\s*(st|nd|rd|th)\s*ed\b", "$1$2 Edition"),
    (r"\b(\d+)\s*(st|nd|rd|th)\s*edition\b", "$1$2 Edition"),
    (r"\b3\s*rd\b", "3rd"),
    (r"\b2\s*nd\b", "2nd"),
    (r"\b1\s*st\b", "1st"),
    (r"\b(\d+)\s*th\b", "$1th"),
)

# Publishers by pattern over titles, in order, any case.
TITLE_PUBLISHERS = (
    ("O'Reilly", r"\b(o'?reilly|oreilly)\b"),
    ("Packt Publishing", r"\b(packt|packtpub)\b"),
    ("Wiley", r"\bwiley\b"),
    ("McGraw-Hill", r"\b(mcgraw[- ]?hill)\b"),
    ("Manning Publications", r"\bmanning\b"),
    ("Apress", r"\bapress\b"),
    ("No Starch Press", r"\b(no starch|nostarch)\b"),
    ("Addison-Wesley", r"\b(addison[- ]?wesley)\b"),
    ("Prentice Hall", r"\b(prentice[- ]?hall)\b"),
    ("MIT Press", r"\bmit press\b"),
    ("Cambridge University Press", r"\bcambridge\b"),
    ("Oxford University Press", r"\boxford\b"),
    ("Springer", r"\bspringer\b"),
    ("CRC Press", r"\bcrc press\b"),
    ("Taylor & Francis", r"\btaylor & francis\b"),
    ("Sybex", r"\bsybex\b"),
    ("Udemy", r"\budemy\b"),
    ("Coursera", r"\bcoursera\b"),
    ("Black & Decker", r"\bblack\s*(&|and)\s*decker\b"),
    ("Adafruit", r"\badafruit\b"),
    ("SparkFun", r"\bsparkfun\b"),
    ("Raspberry Pi Press", r"\braspberry pi press\b"),
    ("Arduino LLC", r"\barduino\b"),
)

# Publishers by pattern over front matter, in order, any case.
PAGE_PUBLISHERS = (
    ("Packt Publishing", r"\b(packt\s+publishing|packtpub|packt>|packt)\b"),
    ("O'Reilly Media", r"\b(o'reilly\s+media|o'reilly|oreilly)\b"),
    ("Manning Publications", r"\b(manning\s+publications|manning)\b"),
    ("Wiley", r"\b(john\s+wiley\s+&\s+sons|wiley)\b"),
    ("Apress", r"\b(apress|springer\s+nature\s+apress)\b"),
    ("No Starch Press", r"\b(no\s+starch\s+press|nostarch)\b"),
    ("McGraw-Hill", r"\b(mcgraw[- ]?hill|mcgraw[- ]?hill\s+education)\b"),
    ("Addison-Wesley", r"\b(addison[- ]?wesley|pearson\s+education)\b"),
    ("Prentice Hall", r"\b(prentice[- ]?hall)\b"),
    ("MIT Press", r"\b(mit\s+press)\b"),
    ("Cambridge University Press", r"\b(cambridge\s+university\s+press|cambridge)\b"),
    ("Oxford University Press", r"\b(oxford\s+university\s+press|oxford)\b"),
    ("Springer", r"\b(springer\s+science|springer\s+nature|springer)\b"),
    ("CRC Press", r"\b(crc\s+press|taylor\s+&\s+francis)\b"),
    ("Sybex", r"\b(sybex)\b"),
    ("Raspberry Pi Press", r"\b(raspberry\s+pi\s+press)\b"),
    ("Black & Decker", r"\b(black\s*(&|and)\s*decker)\b"),
)

# Bracketed tags that name no author.
NON_AUTHORS = (
    "webtooltip.com",
    "freecourselab.com",
    "udemy",
    "coursera",
    "edx",
    "packt",
    "packtpub",
    "oreilly",
    "wiley",
    "manning",
    "apress",
    "mcgraw-hill",
    "mcgraw hill",
    "nostarch",
    "no starch press",
    "sybex",
    "rocketry",
    "electronics",
    "ebook",
    "pdf",
    "epub",
    "1080p",
    "720p",
    "tutorial",
    "chegg",
    "chegg solutions",
    "source files",
    "textbook",
    "solutions",
    "130+",
    "20",
    "30",
    "40",
    "150",
)

# Authors by a word of the title, in order.
KNOWN_AUTHORS = (
    ("Floyd", "Thomas L. Floyd"),
    ("Petruzella", "Frank D. Petruzella"),
    ("Horowitz", "Paul Horowitz & Winfield Hill"),
    ("Art of Electronics", "Paul Horowitz & Winfield Hill"),
    ("Sedra", "Adel S. Sedra & Kenneth C. Smith"),
    ("Boylestad", "Robert L. Boylestad"),
    ("Tanenbaum", "Andrew S. Tanenbaum"),
    ("Silberschatz", "Abraham Silberschatz"),
    ("Knuth", "Donald E. Knuth"),
    ("Cormen", "Thomas H. Cormen, Charles E. Leiserson, Ronald L. Rivest"),
    ("Goodfellow", "Ian Goodfellow, Yoshua Bengio, Aaron Courville"),
    ("Geron", "Aurélien Géron"),
    ("Russell", "Stuart Russell & Peter Norvig"),
    ("Hoyle", "David Hoyle"),
    ("Ahmad", "Imran Ahmad"),
    ("Regas", "Dean Regas"),
    ("Canterbury", "Dave Canterbury"),
    ("Bushcraft 101", "Dave Canterbury"),
    ("Jose Portilla", "Jose Portilla"),
    ("Python for Data Science and Machine Learning", "Jose Portilla"),
    ("Liquid Fuel Rocket", "Leroy J. Krzycki"),
    ("Krzycki", "Leroy J. Krzycki"),
    ("James Stewart", "James Stewart"),
)

# Titles that tell nothing, (pattern, any case).
UNINFORMATIVE = (
    (r"^\d{6,14}$", False),
    (r"^\d{4}[-_]\d{2}[-_]\d{2}$", False),
    (r"^[0-9a-fA-F]{16,}$", False),
    (r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", False),
    (r"^(book|ebook|document|doc|untitled|scan|file|temp|download|sample|test|pdf|free[-_]?learning)$", True),
    (r"^packt[-_]?\d{6,14}$", True),
)

# Taxonomy rules in order: pattern (any case), domain, subject, subfield, genre, audience, key concepts, topics.
TAXONOMY = (
    (
        r"\b(artificial\s+intelligence|agentic\s+ai|generative\s+ai|llm|deep\s+learning|machine\s+learning|neural\s+network|\bai\b|\bml\b|transformers?|gpt|langchain|reinforcement\s+learning|nlp|computer\s+vision|diffusion\s+models?)\b",
        "Computer Science & Artificial Intelligence",
        "Artificial Intelligence & Machine Learning",
        "Deep Learning & Generative AI",
        "Technical Reference",
        "Advanced / Practitioner",
        "Model Architectures, Training Pipelines, Neural Optimization, Embeddings, Agentic Workflows",
        "ai, machine-learning, deep-learning, llm, neural-networks, transformers, nlp, generative-ai",
    ),
    (
        r"\b(data\s+science|data\s+scientist|pandas|numpy|scikit|analytics|big\s+data|data\s+mining|feature\s+engineering|time\s+series)\b",
        "Computer Science & Artificial Intelligence",
        "Data Science & Statistical Analysis",
        "Applied Data Science & Mining",
        "Technical Reference",
        "Intermediate / Practitioner",
        "Exploratory Data Analysis, Statistical Modeling, Feature Extraction, Data Pipelines",
        "data-science, python, statistics, analytics, machine-learning, data-engineering",
    ),
    (
        r"\b(algorithms?|data\s+structures?|software\s+architecture|design\s+patterns?|system\s+design|clean\s+code|refactoring|microservices|api\s+design)\b",
        "Computer Science & Artificial Intelligence",
        "Software Engineering & Computer Science",
        "Algorithms & System Architecture",
        "Textbook / Technical Reference",
        "Intermediate / Advanced",
        "Algorithmic Complexity, Big-O, Data Structures, Distributed Systems, Software Design",
        "algorithms, data-structures, computer-science, software-engineering, architecture",
    ),
    (
        r"\b(python|javascript|typescript|c\+\+|golang|rust|java|react|vue|node\.?js|html|css|php|backend|frontend|fullstack|web\s+development)\b",
        "Computer Science & Software Development",
        "Programming & Software Development",
        "Application & Web Engineering",
        "Technical Guide",
        "Beginner / Intermediate",
        "Syntax, Idiomatic Programming, Frameworks, Application Design, API Integration",
        "programming, software-development, web-development, python, coding, applications",
    ),
    (
        r"\b(cybersecurity|pentest|pentesting|ethical\s+hacking|malware|reverse\s+engineering|cryptography|cryptanalysis|security|wireshark|metasploit|vulnerability|network\s+defense|steganography)\b",
        "Information Security & Networks",
        "Cybersecurity & InfoSec",
        "Penetration Testing & Threat Analysis",
        "Technical Reference",
        "Intermediate / Advanced",
        "Vulnerability Assessment, Exploitation, Network Hardening, Threat Modeling, Cryptography",
        "cybersecurity, infosec, ethical-hacking, pentesting, network-security, reverse-engineering",
    ),
    (
        r"\b(linux|ubuntu|debian|docker|kubernetes|aws|cloud|devops|ansible|terraform|bash|powershell|ci\/cd|server|sysadmin)\b",
        "Information Security & Networks",
        "Cloud Infrastructure & DevOps",
        "Containerization & System Administration",
        "Technical Guide",
        "Intermediate / Practitioner",
        "Infrastructure as Code, Container Orchestration, CI/CD Pipelines, Linux Administration",
        "devops, cloud, linux, docker, kubernetes, sysadmin, aws, infrastructure",
    ),
    (
        r"\b(electric\s+motors?|circuits?|electronics?|the\s+art\s+of\s+electronics|digital\s+fundamentals|microcontroller|arduino|raspberry\s+pi|teensy|esp32|esp8266|stm32|arm|fpga|pcb|sensors?|semiconductors?|dsp|rf|vhdl|verilog|power\s+electronics)\b",
        "Engineering & Applied Physics",
        "Electrical & Embedded Engineering",
        "Circuit Design, Embedded Systems & Hardware",
        "Textbook / Technical Reference",
        "Intermediate / Practitioner",
        "Analog & Digital Circuits, Microcontrollers, Signal Processing, Sensor Interfacing, Hardware Design",
        "electronics, electrical-engineering, embedded-systems, arduino, raspberry-pi, circuits, sensors, pcb",
    ),
    (
        r"\b(lathe|milling|machining|cnc|metalworking|blacksmithing|woodworking|carpentry|welding|sheet\s+metal|manufacturing|solidworks|autocad|cad|cam|workshop|mechanics)\b",
        "Engineering & Applied Physics",
        "Mechanical & Manufacturing Engineering",
        "Machining, Fabrication & Toolmaking",
        "Practical Guide / Manual",
        "Practitioner / Craftsman",
        "Precision Machining, Tooling Geometry, Fabrication, Metal Lathe Operations, CAD/CAM Modeling",
        "mechanical-engineering, machining, lathe, metalworking, fabrication, cnc, manufacturing",
    ),
    (
        r"\b(rocketry|liquid\s+fuel|rocket\s+engine|aerospace|aeronautics|avionics|propulsion|orbital\s+mechanics|ballistics|flight)\b",
        "Engineering & Applied Physics",
        "Aerospace & Aeronautical Engineering",
        "Rocket Propulsion & Orbital Systems",
        "Technical Reference",
        "Advanced / Practitioner",
        "Combustion Dynamics, Nozzle Design, Propellant Chemistry, Avionics, Orbital Trajectories",
        "aerospace, rocketry, propulsion, rocket-engines, aerodynamics, physics",
    ),
    (
        r"\b(chemistry|organic\s+chemistry|biochemistry|chemical|molecular|reactions?|spectroscopy|periodic\s+table|materials\s+science)\b",
        "Natural & Physical Sciences",
        "Chemistry & Chemical Sciences",
        "Organic & Applied Chemistry",
        "Textbook",
        "Academic / Practitioner",
        "Molecular Structures, Reaction Mechanisms, Stoichiometry, Thermodynamics, Synthesis",
        "chemistry, organic-chemistry, science, biochemistry, molecular-science",
    ),
    (
        r"\b(astronomy|astrophysics|night\s+sky|stargazing|telescope|cosmos|universe|planetary|planets|stars|galaxy|cosmology)\b",
        "Natural & Physical Sciences",
        "Astronomy & Space Science",
        "Observational Astronomy & Stargazing",
        "Field Guide / Educational",
        "General / Enthusiast",
        "Celestial Navigation, Constellations, Optics, Planetary Motion, Deep Sky Exploration",
        "astronomy, astrophysics, stargazing, night-sky, space, cosmos, telescopes",
    ),
    (
        r"\b(physics|quantum|thermodynamics|optics|electromagnetism|fluid\s+dynamics|statistical\s+physics|relativity)\b",
        "Natural & Physical Sciences",
        "Physics & Theoretical Physics",
        "Classical & Modern Physics",
        "Textbook",
        "Academic / Advanced",
        "Classical Mechanics, Electrodynamics, Quantum States, Energy Transfer, Mathematical Physics",
        "physics, quantum-mechanics, thermodynamics, electromagnetism, science",
    ),
    (
        r"\b(math|mathematics|calculus|linear\s+algebra|differential\s+equations|geometry|probability|statistics|discrete\s+math|number\s+theory)\b",
        "Formal Sciences & Mathematics",
        "Mathematics & Applied Statistics",
        "Foundational & Advanced Mathematics",
        "Textbook",
        "Academic / Practitioner",
        "Vector Spaces, Differential Operators, Probability Distributions, Proof Methods, Optimization",
        "mathematics, statistics, calculus, linear-algebra, probability, math",
    ),
    (
        r"\b(survival|bushcraft|foraging|edible\s+wild|wilderness|prepper|preppers|first\s+aid|trauma|emergency|shelter|firemaking|cordage|hunting|fishing|trapping|orienteering|navigation|off\s+grid)\b",
        "Outdoor, Survival & Environmental Skills",
        "Survival & Bushcraft",
        "Wilderness Survival & Self-Reliance",
        "Field Guide / Manual",
        "Practitioner / Enthusiast",
        "Wilderness Medicine, Shelter Construction, Foraging & Identification, Navigation, Emergency Preparedness",
        "survival, bushcraft, wilderness, foraging, prepping, first-aid, self-reliance",
    ),
    (
        r"\b(gardening|greenhouse|permaculture|homesteading|beekeeping|apiculture|husbandry|soil|compost|plants|vegetables|hydroponics|aquaponics|orchard|backyard)\b",
        "Agriculture & Homesteading",
        "Horticulture & Permaculture",
        "Sustainable Agriculture & Homesteading",
        "Practical Guide / Manual",
        "Practitioner / Enthusiast",
        "Soil Ecology, Plant Cultivation, Greenhouse Systems, Crop Rotation, Animal Husbandry",
        "gardening, homesteading, permaculture, agriculture, greenhouse, beekeeping",
    ),
    (
        r"\b(home\s+improvement|plumbing|wiring|electrical\s+wiring|masonry|stonework|deck|shed|roofing|concrete|home\s+repair|bathrooms?|remodel|black\s*&\s*decker)\b",
        "Trades, Construction & Home Craft",
        "Construction & Home Improvement",
        "Residential Trades & Remodeling",
        "Practical Guide / Manual",
        "Homeowner / Craftsman",
        "Residential Wiring, Plumbing Diagnostics, Structural Carpentry, Masonry, Code Compliance",
        "home-improvement, construction, plumbing, electrical-wiring, carpentry, remodeling",
    ),
    (
        r"\b(synthesizer|synthesizers|synth|modular\s+synth|eurorack|midi|audio\s+engineering|sound\s+design|music\s+production|acoustics|recording|mixing|mastering)\b",
        "Creative Arts & Music Technology",
        "Audio Engineering & Sound Design",
        "Synthesizers & Electronic Music Production",
        "Technical Reference",
        "Practitioner / Musician",
        "Subtractive/Additive Synthesis, MIDI Protocol, DSP Modulation, Acoustic Treatments, Mixing Signal Chains",
        "audio-engineering, synthesizers, music-production, sound-design, midi, acoustics",
    ),
    (
        r"\b(mind|organize|stoicism|habits|focus|psychology|productivity|cognitive|philosophy|epistemology|thinking|learning|meditation|clear\s+your\s+mind)\b",
        "Humanities & Social Sciences",
        "Personal Development & Philosophy",
        "Cognitive Strategy & Productivity",
        "Non-Fiction / Self-Improvement",
        "General / Practitioner",
        "Habit Architecture, Cognitive Reframing, Time Management, Stoic Principles, Focus Optimization",
        "personal-development, productivity, psychology, philosophy, habits, mindset",
    ),
    (
        r"\b(statement|credit\s+card|invoice|tax|1040|bill|financial|accounting|ledger|banking|econometrics)\b",
        "Business, Finance & Administration",
        "Financial & Administrative Records",
        "Accounting, Taxes & Personal Finance",
        "Financial Document / Record",
        "Administrative / General",
        "Financial Reporting, Ledger Balances, Tax Schedules, Fiscal Accounting",
        "finance, accounting, taxes, financial-records, administrative",
    ),
    (
        r"\b(manifest|diagnostic\s+ecosystem|cybernetic|architecture|system\s+specification|whitepaper)\b",
        "Systems Architecture & Engineering",
        "Systems Architecture & Ecosystems",
        "Cybernetic Diagnostics & Ecosystem Architecture",
        "Project Documentation",
        "Architect / Engineer",
        "Cybernetic Feedback Loops, Diagnostic Pipelines, Multi-Agent Instrumentation, System Design",
        "system-architecture, cybernetics, diagnostics, technical-specification, documentation",
    ),
)

# What a title has that no rule fits.
TAXONOMY_ELSE = (
    "General Science & Technology",
    "Technical & Applied Sciences",
    "General Technical Studies",
    "Technical Reference",
    "General / Practitioner",
    "General Methodologies, Practical Applications, Core Concepts",
    "technology, reference, engineering, science",
)

# Words before a number that make it part of the title.
NUMBERED_WORDS = (
    "volume",
    "vol",
    "part",
    "pack",
    "book",
    "chapter",
    "level",
    "phase",
    "step",
    "grade",
    "class",
    "no",
    "v",
    "edition",
    "issue",
)
