"""A corpus of 52 files with 15 questions whose answers are known: services, logs, scans and recordings with and without text, lists."""

import json
import os
from pathlib import Path

#: A file's stem, its title, what it is about, and its anchor.
SERVICES = """
shipping|Shipping Service|thermal printer printhead replacement|SHIP-NODE-SURYA
billing|Billing Service|payment reconciliation ledger|BILL-LEDGER-204
inventory|Inventory Service|warehouse slotting inventory reserve|INV-SLOT-118
routing|Routing Service|barcode route optimization dispatch|ROUTE-OPT-377
notifications|Notification Service|email webhook retry notification|NOTIFY-HOOK-905
auth|Auth Service|session refresh token auth gate|AUTH-GATE-441
fulfillment|Fulfillment Service|pick pack wave fulfillment|FULFILL-WAVE-266
returns|Returns Service|refund label inspection|RETURN-RMA-559
catalog|Catalog Service|product attribute enrichment|CATALOG-ATTR-083
pricing|Pricing Service|discount rule simulation|PRICE-RULE-702
analytics|Analytics Service|forecast dashboard anomaly|ANALYTICS-CUBE-512
search|Search Service|semantic ranking facet|SEARCH-FACET-931
support|Support Service|case escalation SLA|SUPPORT-SLA-733
mobile|Mobile Service|offline scan sync|MOBILE-SCAN-188
compliance|Compliance Service|retention policy audit|COMP-AUDIT-640
"""
#: A question, the files that answer it, and how many results count.
QUESTIONS = """
thermal printer printhead replacement|shipping_module.md|3
INC-2026-ATLAS-014|syslog_03.txt shipping_module.md|5
active module listing|shipping_module.md billing_module.md inventory_module.md|5
audit log item 42|inventory_audit.json|5
payment reconciliation ledger|billing_module.md|5
barcode route optimization dispatch|routing_module.md|5
warehouse slotting inventory reserve|inventory_module.md|5
email webhook retry notification|notifications_module.md|5
session refresh token auth gate|auth_module.md|5
pick pack wave fulfillment|fulfillment_module.md|5
offline scan sync mobile|mobile_module.md|5
ALERT conveyor thermal threshold|syslog_07.txt|5
VID-APPROVAL-005 invoice approval|img_invoice_02.png|5
SHIP-NODE-SURYA cooling lane|shipping_module.md inventory_audit.json|5
retention policy audit compliance|compliance_module.md|5
"""


def questions():
    """(text, files, k)"""
    own = (line.split("|") for line in QUESTIONS.strip().splitlines())
    return [(text, files.split(), int(k)) for text, files, k in own]


def service_text(stem, title, topic, anchor, repeats):
    text = f"# {title}\n\nThe active module listing has the {title} as owner of {topic}. Its anchor is {anchor}, and the team answers for {topic} day and night.\n"
    if stem == "shipping":
        text += "\nThe incident INC-2026-ATLAS-014 ended when the printhead of the thermal printer was replaced and the cooling lane of SHIP-NODE-SURYA had new labels.\n"
    steps = "\n## Steps\n\n- Look at the queue before anything else.\n- Compare what the devices say with activity_log.csv.\n- Write the outcome down for the next shift.\n\n## More\n\n"
    return text + steps + f"What {title} does about {topic} under {anchor} stands in the active module listing. " * repeats


def log_text(k):
    special = {
        3: "ERROR the atlas gateway met INC-2026-ATLAS-014. Its thermal printer needs a new printhead before labels can leave. What to do stands in shipping_module.md.",
        7: "ALERT conveyor thermal threshold exceeded. The lane was warm for an hour and nobody answered. Somebody should look at the conveyor guard.",
    }
    return f"2026-05-23 hour {k}. " + special.get(k, f"INFO heartbeat of the scanner as on other days, trace SYSLOG-{k:02}. There is nothing to be done about it, the file is kept for the records.")


def build(folder, full=False):
    """Writes the corpus; returns the files that are to be indexed."""
    folder, files = Path(folder), []

    def put(name, text):
        (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())
        if ".extracted." not in name:
            files.append(name)

    def beside(name, text, age):
        side = name.rsplit(".", 1)[0] + ".extracted.txt"
        put(side, text)
        at = os.stat(folder / name).st_mtime + age
        os.utime(folder / side, (at, at))

    note = "telemetry of the inventory as counted " * (150 if full else 15)
    items = [{"item": f"audit log item {k}", "node": "SHIP-NODE-SURYA" if k == 42 else f"NODE-{k:03}", "part": "cooling lane of the thermal printer" if k == 42 else f"part {k % 9}", "note": note} for k in range(60)]
    put("inventory_audit.json", json.dumps({"made": "2026-05-23", "items": items}))
    rows = [f"LOG-{k:05},{'SHIP-NODE-SURYA' if k % 41 == 0 else f'NODE-{k % 200:03}'},{'WARN' if k % 37 == 0 else 'INFO'},{'a drift was seen' if k % 137 == 0 else 'heartbeat and scan'}" for k in range(5000 if full else 500)]
    put("activity_log.csv", "\n".join(["log_id,node,severity,message", *rows]))
    for line in SERVICES.strip().splitlines():
        stem, title, topic, anchor = line.split("|")
        put(f"{stem}_module.md", service_text(stem, title, topic, anchor, 40 if full else 9))
    for k in range(1, 21):
        put(f"syslog_{k:02}.txt", log_text(k))
    for k in range(1, 9):
        put(f"img_invoice_{k:02}.png", b"\x89PNG")
        if k <= 6:
            approval = "The invoice approval VID-APPROVAL-005 confirms that the dock was paid. " * 8
            beside(f"img_invoice_{k:02}.png", approval if k == 2 else f"The invoice of receipt INV-CACHED-{k:03} was read at the dock by the morning shift.", 10 if k <= 4 else -10)
    for k in range(1, 6):
        put(f"video_record_{k:02}.mp4", b"film")
        beside(f"video_record_{k:02}.mp4", f"A note of the dispatch says VID-TRANSCRIPT-{k:03} and when the package moved through the hall.", 10)
    put("readme_master.md", "# Everything\n\nThis active module listing names shipping_module.md, billing_module.md and inventory_module.md, which hold what it only points at. " + "VID-APPROVAL-005 and INC-2026-ATLAS-014 are named here, and SHIP-NODE-SURYA is, but the answers are in those files.\n")
    put("manifest.json", json.dumps({"files": files + ["manifest.json"]}))
    return files
