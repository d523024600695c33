"""They are what they are for right results."""

# Fixed values. Extension lists of file types, in the order in which the first match wins.
TYPE_EXTENSIONS = {
    "document": ["doc", "docx", "pdf", "txt", "rtf", "odt", "xls", "xlsx", "ppt", "pptx", "csv", "md"],
    "picture": ["jpg", "jpeg", "png", "gif", "bmp", "tiff", "tif", "webp", "svg", "ico", "raw", "heic"],
    "video": ["mp4", "avi", "mkv", "mov", "wmv", "flv", "webm", "mpeg", "mpg", "m4v", "3gp"],
    "audio": ["mp3", "wav", "flac", "aac", "ogg", "wma", "m4a", "opus", "aiff"],
    "archive": ["zip", "rar", "7z", "tar", "gz", "bz2", "xz", "iso"],
    "code": ["rs", "py", "js", "ts", "java", "c", "cpp", "h", "hpp", "go", "rb", "php", "swift", "kt"],
    "executable": ["exe", "msi", "bat", "cmd", "ps1", "com", "scr"],
    "script": ["sh", "bash", "zsh", "fish", "csh", "ksh", "awk", "sed", "lua", "pl", "pm", "tcl"],
    "web": ["html", "htm", "css", "scss", "less", "sass", "jsx", "tsx", "vue", "svelte", "wasm", "xhtml"],
    "font": ["ttf", "otf", "woff", "woff2", "eot", "fon"],
    "database": ["db", "sqlite", "sqlite3", "mdb", "accdb", "sql", "ldf", "mdf", "ndf", "dbf"],
    "config": ["ini", "cfg", "conf", "yaml", "yml", "toml", "json", "xml", "env", "properties", "reg", "inf", "plist"],
    "log": ["log", "out", "err", "trace", "evt", "evtx"],
    "backup": ["bak", "old", "orig", "swp", "tmp", "temp", "~"],
    "disk": ["vmdk", "vhd", "vhdx", "vdi", "qcow2", "img", "wim", "iso", "dmg"],
    "data": ["csv", "tsv", "parquet", "avro", "arrow", "ndjson", "jsonl", "dat", "sav", "hdf5"],
    "cad": ["dwg", "dxf", "step", "stp", "stl", "obj", "fbx", "blend", "3ds", "gltf", "glb"],
    "shortcut": ["lnk", "url", "desktop", "webloc"],
    "system": ["sys", "dll", "drv", "ocx", "cpl", "ax", "mui"],
    "cert": ["pem", "crt", "cer", "der", "pfx", "p12", "key", "csr", "jks"],
    "ebook": ["epub", "mobi", "azw", "azw3", "djvu", "cbr", "cbz"],
}
# Fixed values. The executables collection of extension filters is wider than the type.
EXECUTABLE_COLLECTION = ["exe", "msi", "bat", "cmd", "ps1", "com", "scr", "vbs", "wsf", "dll", "sys"]
# Fixed values. Collection names in extension filters.
COLLECTIONS = {"pictures": "picture", "images": "picture", "documents": "document", "docs": "document", "videos": "video", "video": "video", "music": "audio", "audio": "audio", "archives": "archive", "compressed": "archive", "code": "code", "source": "code"}
# Fixed values. Attribute bits.
ATTRIBUTES = {
    "readonly": 0x1, "hidden": 0x2, "system": 0x4, "directory": 0x10, "archive": 0x20, "device": 0x40, "normal": 0x80, "temporary": 0x100, "sparse": 0x200, "reparse": 0x400, "compressed": 0x800,
    "offline": 0x1000, "notindexed": 0x2000, "encrypted": 0x4000, "integrity": 0x8000, "virtual": 0x10000, "noscrub": 0x20000, "recall_on_open": 0x40000, "pinned": 0x80000, "unpinned": 0x100000, "recall_on_data_access": 0x400000,
}
# Fixed values. Names of file-system metafiles.
METAFILES = [
    "$mft", "$mftmirr", "$logfile", "$volume", "$attrdef", "$bitmap", "$boot", "$badclus", "$secure", "$upcase", "$extend", "$objid", "$quota",
    "$reparse", "$usnjrnl", "$rmmetadata", "$deleted", "$repair", "$tops", "$txflog", "$txf",
]
# Fixed values. Reason bits of journal records.
REASON_DATA_EXTEND = 0x2
REASON_DATA_TRUNCATION = 0x4
REASON_CREATE = 0x100
REASON_DELETE = 0x200
REASON_RENAME_NEW = 0x2000
REASON_BASIC_INFO = 0x8000
REASON_CLOSE = 0x80000000
# Fixed values. The 15 attribute bits of the parity column.
PARITY_MASK = 0x1AFE37
# Fixed values. Age classes: name and upper bound in days.
AGE_BUCKETS = [("Today", 1), ("This week", 7), ("This month", 30), ("Last 90 days", 90), ("This year", 365), ("1 – 3 years", 3 * 365), ("3 – 10 years", 10 * 365), ("> 10 years", None)]
# Fixed values. Columns of a text export in their usual order.
BASELINE_COLUMNS = ["path", "name", "path_only", "size", "size_on_disk", "created", "modified", "accessed", "descendants", "attributes"]
# Fixed values. Columns of a parity export in their order.
PARITY_COLUMNS = [
    "path", "name", "path_only", "size", "size_on_disk", "created", "modified", "accessed", "descendants", "read_only", "archive", "system", "hidden", "offline",
    "not_indexed", "no_scrub", "integrity", "pinned", "unpinned", "directory_flag", "compressed", "encrypted", "sparse", "reparse", "parity_attributes",
]
# Fixed values. Characters that a literal text needs escaped in a regex.
REGEX_META = ".+*?^$()[]{}|\\"
# Fixed values. 100 ns ticks between 1601 and 1970.
FILETIME_EPOCH = 116_444_736_000_000_000
# Fixed values. Size classes: name and upper bound.
SIZE_BUCKETS = [("Tiny", 1 << 10), ("Small", 100 << 10), ("Medium", 1 << 20), ("Large", 100 << 20), ("Huge", 1 << 30), ("Giant", 10 << 30), ("Colossal", None)]
SIZE_BOUNDS = [1 << 10, 100 << 10, 1 << 20, 100 << 20, 1 << 30, 10 << 30]
PATH_RISK = [("Safe", 128), ("Long", 200), ("Warning", 260), ("Critical", None)]
BULKINESS_SCALE = 1_000_000
