import sys

from wardflow.cli import main

sys.exit(main())
