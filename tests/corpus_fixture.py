"""A small corpus on disk: settings, Python, Markdown with links and calls, a broken Python file and a folder to pass over."""

FILES = {
    "产品/settings.yaml": "service:\n  name: cortex\n  api_key: cortex-secret\n  hosts:\n    - a.example\n    - b.example\n",
    "工程/bootstrap_session.py": "import json\nfrom helpers import tool\n\ndef bootstrap_session(name):\n    \"\"\"Starts a session.\"\"\"\n    return json.dumps({'name': name})\n\nclass SessionStore:\n    def save(self, item):\n        return item\n",
    "工程/startup.md": "# Boot sequence\n\nThe startup orchestration runs the boot sequence in order and waits for each service.\n",
    "工程/session_playbook.md": "# Session playbook\n\nSee [startup](./startup.md) first, then call `bootstrap_session` to begin.\n\n## Steps\n\n- open the store\n- close it\n",
    "产品/session_bridge.md": "# Bridge\n\nThis note points to 工程/session_playbook.md for details of sessions.\n",
    "工程/helpers.py": "def tool():\n    return 1\n",
    "工程/nested/invalid.py": "def broken(:\n    pass\n",
    "node_modules/ignored.py": "def ignored():\n    pass\n",
    "聊天/group.md": "**Ann** `[2024-01-01 10:00:00]`\nhello there everyone\n\n**Bob** `[2024-01-01 10:05:00]`\n![x](a.png)\nfine thanks\n\n**系统提示** `[2024-01-01 10:06:00]`\nBob 撤回了一条消息\n\n**Ann** `[bad]`\n\n**Ann** `[2024-01-01 20:00:00]`\nlate words\n",
}


def write(root):
    for path, body in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(body)
    return str(root)


def extract(text):
    """Concepts and decisions by fixed words, as a model would give them."""
    found = {"concepts": [], "decisions": [], "usage": {"total_tokens": len(text)}}
    if "boot sequence" in text.lower():
        found["concepts"].append({"name": "Boot", "summary": "how it starts", "aliases": ["boot sequence"]})
    if "bootstrap_session" in text and "playbook" in text.lower():
        found["concepts"].append({"name": "boot", "summary": "", "aliases": ["startup"]})
        found["decisions"].append({"name": "Call it first", "summary": "order", "aliases": [], "rationale": ["Boot Sequence"]})
    if "broken" in text:
        raise ValueError("no answer")
    return found
