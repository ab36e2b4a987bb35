"""``python -m quarrylight TOOL ...``: see ``quarrylight.cli``."""

import sys

from quarrylight.cli import main

if __name__ == "__main__":
    try:
        main(sys.argv[1:])
    except KeyboardInterrupt:
        sys.exit("\nInterrupted.")
