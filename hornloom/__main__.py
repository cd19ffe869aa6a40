import sys

from hornloom.cli import main

sys.exit(main())
