"""Fixed values that results depend on: word lists, tables and patterns, in plain text."""

# First words of structural headings, header boilerplate, the basis clause.
HEADINGS = ("Chương", "Điều", "Mục")
BOILERPLATE = ("QUỐC HỘI", "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM", "Độc lập - Tự do - Hạnh phúc", "------")
BASIS = "Căn cứ"

# Tone marks move from the first to the second vowel.
TONE_MARKS = {
    "òa": "oà", "óa": "oá", "ỏa": "oả", "õa": "oã", "ọa": "oạ",
    "òe": "oè", "óe": "oé", "ỏe": "oẻ", "õe": "oẽ", "ọe": "oẹ",
    "ùy": "uỳ", "úy": "uý", "ủy": "uỷ", "ũy": "uỹ", "ụy": "uỵ", "Ủy": "Uỷ",
}

# Abbreviations that keep their stops and marks. BT. is meant without the invisible mark that its source holds before it.
ABBREVIATIONS = """
M.City V.I.P PGS.Ts MRS. Mrs. Man.United Mr. SHB.ĐN Gs.Bs U.S.A TMN.CSG Kts.Ts R.Madrid Tp. T.Ư D.C Gs.Tskh PGS.KTS GS.BS KTS.TS
PGS-TS Co. S.H.E Ths.Bs T&T.HN MR. Ms. T.T.P TT. TP. ĐH.QGHN Gs.Kts Man.Utd GD-ĐT T.W Corp. ĐT.LA Dr. T&T HN.ACB GS.KTS MS. Prof.
GS.TS PGs.Ts PGS.BS BT. Ltd. ThS.BS Gs.Ts SL.NA Th.S Gs.Vs PGs.Bs T.O.P PGS.TS HN.T&T SG.XT O.T.C TS.BS Yahoo! Man.City MISS. HA.GL
GS.Ts TBT. GS.VS GS.TSKH Ts.Bs M.U Gs.TSKH U.S Miss. GD.ĐT PGs.Kts St. Ng. Inc. Th. N.O.V.A
""".split()

# Words with digits or marks that stay whole.
EXCEPTIONS = """
Wi-fi 17+ km/h M7 M8 21+ G3 M9 G4 km3 m/s km2 5g 4G 8K 3g E9 U21 4K U23 Z1 Z2 Z3 Z4 Z5 Jong-un u19 5s wi-fi 18+ Wi-Fi m2 16+ m3
V-League Geun-hye 5G 4g Z3+ 3G km/s 6+ u21 WI-FI u23 U19 6s 4s
""".split()

# The token patterns, in the order in which they are tried; digits and word characters are ASCII, letters and signs of money Unicode.
_NUMBER = r"[-+]?[0-9]+([.,][0-9]+)*%?\p{Sc}?"
PATTERNS = {
    "ellipsis": r"\.{2,}",
    "email": r"([A-Za-z0-9_.-]+)@(([A-Za-z0-9_-]+)\.)*([A-Za-z0-9_-]+)",
    "url": r"(((https?|ftp)://|www\.)[^\s/$.?#].[^\s]*)|(https?://)?(www\.)?[-a-zA-Z0-9@:%._+~#=]{2,256}\.[a-z]{2,6}\b([-a-zA-Z0-9@:%_+.~#?&/=]*)",
    "full_date": r"(0?[1-9]|[12][0-9]|3[01])(/|-|\.)(1[0-2]|(0?[1-9]))((/|-|\.)[0-9]{4})",
    "month": r"(1[0-2]|(0?[1-9]))(/)[0-9]{4}",
    "date": r"(0?[1-9]|[12][0-9]|3[01])(/)(1[0-2]|(0?[1-9]))",
    "time": r"([0-9][0-9]:[0-9][0-9]:[0-9][0-9])|((0?[0-9]|1[0-9]|2[0-3])(:|h)(0?[0-9]|[1-5][0-9])(’|'|p|ph)?)",
    "money": r"\p{Sc}[0-9]+([.,][0-9]+)*|[0-9]+([.,][0-9]+)*\p{Sc}",
    "phone": r"(\(?\+[0-9]{1,2}\)?[\s.-]?)?[0-9]{2,}[\s.-]?[0-9]{3,}[\s.-]?[0-9]{3,}",
    "short_name": r"([\p{L}]+([.\-][\p{L}]+)+)|([\p{L}]+-[0-9]+)",
    "number_expression": rf"{_NUMBER}([+\-*/]{_NUMBER})*",
    "number": _NUMBER,
    "hyphen_word": r"\p{L}+-\p{L}+(-\p{L}+)*",
    # ⟨ ⟩ « » stand for marks that their source holds wrongly decoded.
    "punctuation": r",|\.|:|\?|!|;|-|_|\"|'|“|”|\||\(|\)|\[|\]|\{|\}|⟨|⟩|«|»|\\|/|‘|’|…|·",
    "special_char": r"~|@|#|\^|&|\*|\+|-|–|<|>|\|",
    "all_caps": r"[A-Z]+\.[A-Z]+",
}
SENTENCE_END = r"(\.+|\?|!|…)"
CLOSING = ("”", "'", ")", "}", "]")

# Names of part-of-speech tags.
POS_NAMES = {
    "N": "Noun (Danh từ)", "Np": "Proper noun (Danh từ riêng)", "Nc": "Classifier noun (Danh từ giống loại)", "Nu": "Unit noun (Danh từ đơn vị)",
    "V": "Verb (Động từ)", "Vb": "Verb (base) (Động từ gốc)", "A": "Adjective (Tính từ)", "Ai": "Adjective (predicative) (Tính từ vị ngữ)",
    "P": "Pronoun (Đại từ)", "R": "Adverb (Trạng từ)", "M": "Numeral / number (Số từ)", "E": "Preposition / particle (Giới từ / trợ từ)",
    "C": "Coordinating conjunction (Liên từ phối hợp)", "CC": "Subordinating conjunction / complementizer (Liên từ phụ thuộc)",
    "L": "Determiner / article (Từ hạn định)", "D": "Adverbial marker / degree marker (Từ chỉ mức độ)", "X": "Other (Khác)", "CH": "Punctuation (Dấu câu)",
}

# What the triplet rules read off tags and words.
DROPPED_POS = ("R", "CH", "E", "L", "M")
COORDINATORS = ("và", "hoặc", ",", ";")
VERB_LABELS = ("nmod", "x", "conj", "prd", "tpc", "dep")
KEPT_POS = ("N", "V", "A", "E", "M")
AUXILIARIES = ("được", "bị", "đang", "đã", "sẽ")
DETERMINERS = ("các", "những", "một", "mỗi", "toàn_bộ", "tất_cả", "cả")
NO_OBJECTS = ("sau", "như", "như sau", "ví dụ", "v.v", "v.v.")
DUTY_NOUNS = ("trách nhiệm", "nhiệm vụ", "quyền", "bổn phận", "nghĩa vụ")
